"""Enumerations, patterns, thresholds and limits of the finding model.

These values decide results, so they are stated once here and nowhere else.
"""

# --- enumerations -----------------------------------------------------------
FINDING_TYPES = [
    "spelling", "grammar", "punctuation", "page_number", "chapter_alignment",
    "unit_alignment", "heading", "flow", "learning_outcomes", "image",
    "examples", "wording", "alignment", "layout", "typography", "spacing",
    "overflow", "inconsistency", "number", "other",
]
SEVERITIES = ["critical", "major", "minor"]
STATUSES = ["open", "accepted", "dismissed", "fixed"]
LANGUAGES = ["auto", "english", "hindi", "mixed"]
BOOK_TYPES = ["textbook", "workbook", "story", "general"]
MEASURED_SOURCES = ["pdf_text", "ocr_text"]
MARK_TYPES = ["circle", "square", "highlight"]

# Types that need printed text before a finding counts as verified.
LANGUAGE_TYPES = ["spelling", "grammar", "punctuation", "typography", "heading", "wording"]
# Types whose finding may be identified by its text change.
TEXT_TYPES = ["spelling", "grammar", "punctuation", "page_number", "heading", "flow",
              "examples", "wording", "typography", "inconsistency", "number"]
VISUAL_TYPES = ["image", "alignment", "layout", "spacing", "overflow"]
REPEATABLE_TYPES = ["spelling", "grammar", "punctuation", "typography", "inconsistency", "wording"]
OBSERVATION_TYPES = ["spelling", "grammar", "punctuation", "heading", "typography", "wording", "other"]

CATEGORY_OF_TYPE = {
    "spelling": "Grammar", "grammar": "Grammar", "punctuation": "Grammar",
    "wording": "Grammar", "flow": "Grammar",
    "chapter_alignment": "Structure", "unit_alignment": "Structure", "heading": "Structure",
    "learning_outcomes": "Pedagogy",
    "number": "Accuracy", "page_number": "Accuracy", "factual": "Accuracy", "examples": "Accuracy",
    "image": "Formatting", "alignment": "Formatting", "layout": "Formatting",
    "spacing": "Formatting", "overflow": "Formatting",
}
# Score buckets in test order: (bucket, substrings of the lower-cased category).
SCORE_BUCKETS = [
    ("Syntax Health", ["grammar", "spell", "syntax", "punctuation", "typograph", "word"]),
    ("Curriculum Alignment", ["format", "layout", "pedagog", "structure", "align", "curricul"]),
    ("Fact Accuracy", ["fact", "accura", "logic", "math", "reason"]),
]
SCORE_DEFAULT = "Style & Consistency"

# --- patterns (Java syntax; ASCII word boundaries written as look-arounds) ---
WB = "(?<![A-Za-z0-9_])"
WE = "(?![A-Za-z0-9_])"
P_HEADING_COLON = r"(?:^|[\n.!?])[ \t]*([A-Za-z0-9 \t()]{2,45}?)[ \t]+(:-|:—|:)[ \t]*"
# A leftmost match of [A-Za-z0-9]+ always begins a run, so the look-behind changes no match;
# it stops the engine from retrying every position of a long run.
P_CONJUNCTION_COLON = r"(?i)(?<![A-Za-z0-9])([A-Za-z0-9]+)\s*:\s+(and|or|as well as)" + WE
P_PAGE_LABEL = r"(?i)" + WB + r"(?:Page|Pg\.?)\s*(\d+)" + WE
P_EXAMPLE = r"(?i)" + WB + r"(Solved Example|Example|Illustration|Activity)\s*(\d+)" + WE
P_MALFORMED_COLON = r"(?<![A-Za-z0-9])([A-Za-z0-9]+)\s*(::|\s+-\s+:)\s*"
P_MODAL_CAPITAL = WB + r"(will|shall|would|could|should|must|may|might|can)\s+(Complete)" + WE
P_LINE_HEADING = r"(?i)^(Unit|Chapter|Ch\.?)[ \t-]*(\d+)\s*[:.\-–—]\s*([^.!?]{2,80})$"
P_TOC_LINE = r"^\s*(\d+)\s*[.:\-]?\s+(.{3,70}?)\s+(\d{1,3})\s*$"
P_BODY_HEADING = (r"(?i)(?:^|\s)(?:chapter|ch\.?|अध्याय)\s*(\d+)\s*[:.\-–—]?\s*"
                  r"([^.!?।]{2,90})")
P_LETTER_RULE = r"(?i)Move\s+(\d+)\s+letters?\s+forward,?\s+then\s+(\d+)\s+letters?\s+backward"
P_UPLOAD_KEY = r"^proofreader_assets/pdf_[A-Za-z0-9._-]+$"
P_CONTENTS = r"(?i)" + WB + r"(?:contents|table of contents|index)" + WE
P_CONTENTS_PRINTED = (r"(?i)" + WB + r"(?:Table\s+of\s+Contents|Contents|INDEX)" + WE
                      + r"|विषय[ -]सूची")

# --- limits -----------------------------------------------------------------
MAX_PDF_BYTES = 250 * 1024 * 1024
MAX_PDF_PARTS = 64
ANALYSIS_VERSION = "chapter-context-v2"
NATIVE_MIN_LETTERS = 120
NATIVE_MIN_WORDS = 25
INDEXED_MIN_CHARS = 180
MAX_BOX_AREA = 400_000.0
DUPLICATE_OVERLAP = 0.6
OCR_PASS_OVERLAP = 0.65
FAILURES_BEFORE_PAUSE = 3

# Words ignored by retrieval.
STOP_WORDS = [
    "about", "after", "again", "also", "and", "are", "because", "been", "before", "being",
    "can", "could", "does", "for", "from", "have", "into", "its", "more", "page", "section",
    "should", "that", "the", "their", "then", "this", "what", "when", "where", "which", "with", "would",
]
# Instructions already built into the review, dropped from project instructions.
BUILT_IN_INSTRUCTIONS = [
    r"do not rewrite.*style", r"only flag objective errors", r"no space.*heading.*colon",
    r"no colon.*before.*(?:and|conjunction)", r"return.*exact quote", r"check.*punctuation",
]
