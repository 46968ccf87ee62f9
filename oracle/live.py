"""Oracle SQL of tables that streams keep up to date: what the batch queries say about the present state."""
from oracle import review  # noqa: F401  (its views)
from oracle.base import compose
from oracle.stats import ORACLES as BATCH

ORACLES = {
    "s6_live_totals": f"""SELECT a.*, p.expected, p.progress, p.eta_seconds, r.success, r.pages_reviewed, r.visual_pending, r.issue_count, r.print_ready, r.high, r.medium, r.low, r.subjects,
      s.* EXCLUDE (book_id) FROM ({BATCH['f1_book_status']}) a JOIN ({BATCH['f5_progress']}) p ON p.book_id = a.book_id
      JOIN ({BATCH['f3_review_summary']}) r ON r.book_id = a.book_id JOIN ({BATCH['scorecard']}) s ON s.book_id = a.book_id""",
    "s2_live_decisions": compose("SELECT book_id, page_number, uid, decided AS status FROM last_v"),
}
