"""Identity of findings: duplicates, merging and reconciliation across runs.

Two findings are one occurrence when they have the same uid, or make the same change (or quote
the same phrase) at the same place. That relation is not transitive, so merging follows the
order of the findings. Only findings that share a key with another one need that order; they go
through a small function, many whole pages at a time, all others never leave the JVM.
"""
from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliocheck import constants as C
from foliocheck.functions import geometry as G, text as T
from foliocheck.operators import findings as O
from foliocheck.session import ship_package

PAGE = ["book_id", "page_number"]
BOX = ["xmin", "ymin", "xmax", "ymax"]
MERGE_COLUMNS = ["uid", "book_id", "page_number", "seq", "type", "severity", "quote", "suggestion", "explanation", *BOX,
                 "box_source", "source", "text_start", "text_end", "confidence", "status"]
MERGE_SCHEMA = ("uid string, book_id string, page_number int, seq bigint, type string, severity string, quote string, "
                "suggestion string, explanation string, xmin double, ymin double, xmax double, ymax double, box_source string, "
                "source string, text_start int, text_end int, confidence double, status string")
HISTORY_SCHEMA = MERGE_SCHEMA + ", seen_in_latest boolean, first_detected_at timestamp, last_detected_at timestamp"


def with_keys(findings: DataFrame) -> DataFrame:
    """Adds clean texts, the minimal edit, and whether the offset is verified."""
    f = findings.withColumn("cq", T.clean_text(F.col("quote"))).withColumn("cs", T.clean_text(F.col("suggestion")))
    f = f.withColumn("edit", T.minimal_edit(F.col("cq"), F.col("cs")))
    offset = F.coalesce(F.col("text_start") >= 0, F.lit(False))
    return (f.withColumn("verified", offset & (O.is_measured() | F.coalesce(F.col("source") == "linter", F.lit(False))))
            .withColumn("change_at", F.when(offset, F.col("text_start") + F.coalesce("edit.start", F.lit(0))))
            .withColumn("change", F.coalesce(F.concat_ws("\u0001", "edit.before", "edit.after"), F.lit("")))
            .withColumn("phrase", F.concat_ws("\u0001", "cq", "cs")).withColumn("usable", G.usable()))


def duplicate_pairs(findings: DataFrame) -> DataFrame:
    """Pairs (l_uid, r_uid) of findings on one page that describe the same occurrence, earlier first."""
    k = with_keys(findings).filter("cq <> ''").select(
        "uid", *PAGE, "seq", "type", "edit", "change", "change_at", "phrase", "verified", "usable", *BOX)

    def side(p: str) -> DataFrame:
        return k.select([F.col(c).alias(p + c) for c in k.columns])
    l, r = side("l_"), side("r_")
    page = [F.col("l_" + c) == F.col("r_" + c) for c in PAGE]
    earlier = F.struct("l_seq", "l_uid") < F.struct("r_seq", "r_uid")
    types = (F.col("l_type") == F.col("r_type")) | (
        F.col("l_type").isin(C.TEXT_TYPES) & F.col("r_type").isin(C.TEXT_TYPES) & F.col("l_verified") & F.col("r_verified"))
    # The same change at the same place; without a change the phrases must be the same.
    changed = page + [F.col("l_change_at") == F.col("r_change_at"), F.col("l_edit").isNull() == F.col("r_edit").isNull(),
                      F.when(F.col("l_edit").isNull(), F.col("l_phrase")).otherwise(F.col("l_change"))
                      == F.when(F.col("r_edit").isNull(), F.col("r_phrase")).otherwise(F.col("r_change")), earlier, types]
    a = l.join(r, changed).select("l_uid", "r_uid")
    box = [[F.col(p + c) for c in BOX] for p in ("l_", "r_")]
    covered = G.overlap(*box) / F.least(G.area(box[0]), G.area(box[1])) >= C.DUPLICATE_OVERLAP
    phrased = page + [F.col("l_type") == F.col("r_type"), F.col("l_phrase") == F.col("r_phrase"), F.col("l_usable"), F.col("r_usable"),
                      earlier, covered]
    b = l.join(r, phrased).select("l_uid", "r_uid")
    return a.unionByName(b).distinct()


# --- the same relation for one page in order ---------------------------------------------------

#: What identity needs of the texts: the change (or the phrase, where nothing changes), the phrase, and where in the quote the change starts.
KEY_COLUMNS = ["what", "phrase", "edit_at"]
KEY_SCHEMA = ", what string, phrase string, edit_at int"
_PLACED = [*BOX, "box_source", "text_start", "text_end"]


def keyed(findings: DataFrame) -> DataFrame:
    """Adds KEY_COLUMNS; a finding without a quote has none and equals another one only by uid."""
    what = F.when(F.col("edit").isNotNull(), F.concat(F.lit("c"), "change")).otherwise(F.concat(F.lit("p"), "phrase"))
    k = with_keys(findings).withColumn("what", F.when(F.col("cq") != "", what))
    return k.withColumn("edit_at", F.coalesce("edit.start", F.lit(0)).cast("int")).select(*findings.columns, *KEY_COLUMNS)


class Occurrences:
    """Findings of some pages, looked up by their page and the keys that make two of them one occurrence.

    Findings are numbers of rows in review order, so the earliest match is the smallest number. A finding that takes over a measured
    place is entered again under it; entries it has outgrown are recognised by their place.
    """

    def __init__(self, rows: pd.DataFrame):
        self.page = rows.groupby(PAGE, dropna=False, sort=False).ngroup().tolist()
        measured = rows["box_source"].isin(C.MEASURED_SOURCES)
        start = pd.to_numeric(rows["text_start"], errors="coerce").astype(float)
        start = start.where(start >= 0)
        corners = rows[BOX].astype(float)
        width, height = corners["xmax"] - corners["xmin"], corners["ymax"] - corners["ymin"]
        fits = measured & np.isfinite(corners).all(axis=1) & (width > 0) & (height > 0) & (width * height <= C.MAX_BOX_AREA)
        self.measured, self.fits = measured.tolist(), fits.tolist()
        self.place = [(w, s + e) if isinstance(w, str) and s == s else None for w, s, e in zip(rows["what"], start, rows["edit_at"])]
        self.label = [(t, p) if isinstance(w, str) and ok else None for t, p, w, ok in zip(rows["type"], rows["phrase"], rows["what"], fits)]
        self.corners = corners.to_numpy().tolist()
        self.proven = (start.notna() & (measured | (rows["source"] == "linter")) & rows["type"].isin(C.TEXT_TYPES)).tolist()
        self.kind, self.uid, self.what, self.phrase, self.edit_at = (rows[c].tolist() for c in ("type", "uid", "what", "phrase", "edit_at"))
        self.start, self.linter = start.tolist(), (rows["source"] == "linter").tolist()
        self.entries: dict[tuple, list[int]] = {}

    def enter(self, i: int) -> None:
        for key in (("uid", self.uid[i]), ("place", self.place[i]), ("label", self.label[i])):
            if key[1]:
                self.entries.setdefault((self.page[i], *key), []).append(i)

    def earliest(self, j: int, taken: set[int] | frozenset = frozenset()) -> int | None:
        """The first entered finding, none of `taken`, that is the same occurrence as j."""
        page = self.page[j]
        matches = list(self.entries.get((page, "uid", self.uid[j]), ())) if self.uid[j] else []
        if self.place[j]:
            matches += [i for i in self.entries.get((page, "place", self.place[j]), ())
                        if self.place[i] == self.place[j] and (self.kind[i] == self.kind[j] or self.proven[i] and self.proven[j])]
        if self.label[j]:
            matches += [i for i in self.entries.get((page, "label", self.label[j]), ()) if self._covered(i, j) >= C.DUPLICATE_OVERLAP]
        return min((i for i in matches if i not in taken), default=None)

    def _covered(self, i: int, j: int) -> float:
        a, b = self.corners[i], self.corners[j]
        shared = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        return shared / min((c[2] - c[0]) * (c[3] - c[1]) for c in (a, b))

    def take_place(self, i: int, j: int) -> None:
        """i stays, at the measured place of j."""
        self.measured[i], self.corners[i] = True, self.corners[j]
        self.start[i] = self.start[j]
        known = self.start[i] == self.start[i]
        self.place[i] = (self.what[i], self.start[i] + self.edit_at[i]) if known and isinstance(self.what[i], str) else None
        self.label[i] = (self.kind[i], self.phrase[i]) if self.fits[j] and isinstance(self.what[i], str) else None
        self.fits[i], self.proven[i] = self.fits[j], known and self.kind[i] in C.TEXT_TYPES
        self.enter(i)


def merged(rows: pd.DataFrame, first: int = 0, seen: Occurrences | None = None) -> tuple[list[int], dict[int, int], Occurrences]:
    """(rows that stay, row whose place each of some takes, the lookup) for the rows from number `first` on, in review order."""
    seen = seen or Occurrences(rows)
    stay, place_of = [], {}
    for j in range(first, len(rows)):
        i = seen.earliest(j)
        if i is None:
            stay.append(j)
            seen.enter(j)
        elif seen.measured[j] and not seen.measured[i]:
            seen.take_place(i, j)
            place_of[i] = j
    return stay, place_of, seen


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["seq", "uid"], kind="stable").reset_index(drop=True)


def _moved(rows: pd.DataFrame, chosen: list[int], place_of: dict[int, int]) -> pd.DataFrame:
    """The chosen rows, each at its final place."""
    out = rows.iloc[chosen].reset_index(drop=True)
    out[_PLACED] = rows[_PLACED].iloc[[place_of.get(i, i) for i in chosen]].reset_index(drop=True)
    return out


def merge_pages(rows: pd.DataFrame) -> pd.DataFrame:
    """First finding of an occurrence stays; a later measured box replaces an estimated one."""
    rows = _ordered(rows)
    stay, place_of, _ = merged(rows)
    return _moved(rows, stay, place_of)


def update_history(old: pd.DataFrame, new: pd.DataFrame, now: dt.datetime, mark_unseen: bool = True) -> pd.DataFrame:
    """History of some pages after an analysis: nothing is lost, decisions and identities stay.

    Both frames have the history and key columns; so has the result, old findings first.
    """
    columns = [*HISTORY_COLUMNS, *KEY_COLUMNS]
    old, new = _ordered(old[columns]), _ordered(new[columns])
    rows = pd.concat([f.astype(object) for f in (old, new)], ignore_index=True)
    stay, place_of, lookup = merged(rows, len(old))
    lookup.entries = {}
    for i in range(len(old)):
        lookup.enter(i)
    again: dict[int, int] = {}
    for j in stay:
        i = lookup.earliest(j, again.keys())
        if i is not None:
            again[i] = j
    matched = set(again.values())
    fresh = [j for j in stay if j not in matched]
    chosen = [again.get(i, i) for i in range(len(old))] + fresh
    out = _moved(rows, chosen, place_of)
    kept = rows.iloc[[*range(len(old)), *fresh]].reset_index(drop=True)
    out["uid"], out["seq"] = kept["uid"], kept["seq"]
    found = pd.Series([i in again for i in range(len(old))] + [True] * len(fresh), dtype=bool)
    is_new = pd.Series([False] * len(old) + [True] * len(fresh), dtype=bool)
    blank = kept["status"].isna() | (kept["status"] == "")
    out["status"] = kept["status"].mask(blank & found, "open")
    earlier = kept["seen_in_latest"].map(lambda v: v is not False and v != False)  # noqa: E712  unknown counts as seen
    out["seen_in_latest"] = found | (earlier & (not mark_unseen))
    first = kept["first_detected_at"].where(kept["first_detected_at"].notna(), kept["last_detected_at"])
    out["first_detected_at"] = first.where(first.notna() & ~is_new, now)
    out["last_detected_at"] = kept["last_detected_at"].mask(found, now)
    return out[columns]


def typed(rows: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """The columns in types that the result schema takes; missing numbers stay missing."""
    out = rows[columns].reset_index(drop=True)
    for c in ("text_start", "text_end", "edit_at"):
        if c in columns:
            out[c] = pd.to_numeric(out[c], errors="coerce").astype("Int32")
    for c in (*BOX, "confidence"):
        out[c] = out[c].astype(float)
    for c in ("first_detected_at", "last_detected_at"):
        if c in columns:
            out[c] = pd.to_datetime(out[c])
    return out


def _shared() -> Column:
    """Whether another finding of the page shares the change, the phrase or the uid."""
    def many(*key) -> Column:
        return F.count("*").over(W.partitionBy(*PAGE, *key)) > 1
    return F.col("what").isNotNull() & (many("what") | many("phrase")) | many("uid")


def _in_order(rows: DataFrame, decide, schema: str) -> DataFrame:
    """The rows of each page decided together. Rows lie by page already; a batch holds many pages, so none pays for a call of its own, and the
    last page of a batch waits for the rest of its rows."""
    def run(batches):
        waiting = None
        for batch in batches:
            pages = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            if len(pages):
                number = pages.groupby(PAGE, dropna=False, sort=False).ngroup()
                last = number == number.iloc[-1]
                waiting = pages[last]
                if not last.all():
                    yield decide(pages[~last].reset_index(drop=True))
        if waiting is not None:
            yield decide(waiting.reset_index(drop=True))
    return rows.sortWithinPartitions(*PAGE).mapInPandas(run, schema)


def merge_findings(findings: DataFrame) -> DataFrame:
    """One finding per occurrence; singletons pass through natively."""
    ship_package(findings.sparkSession)
    k = keyed(findings.select(MERGE_COLUMNS).repartition(*PAGE)).withColumn("shared", _shared())

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        return typed(merge_pages(pdf), MERGE_COLUMNS)
    twins = _in_order(k.filter("shared").select(*MERGE_COLUMNS, *KEY_COLUMNS), decide, MERGE_SCHEMA)
    return k.filter("NOT shared").select(MERGE_COLUMNS).unionByName(twins)


HISTORY_COLUMNS = [*MERGE_COLUMNS, "seen_in_latest", "first_detected_at", "last_detected_at"]


def reconcile(previous: DataFrame, detected: DataFrame, analyzed_at: dt.datetime, mark_unseen: bool = True) -> DataFrame:
    """Previous findings updated by the detected ones; both keep one row per finding.

    `previous` has the history columns, `detected` the merge columns. Only findings that share a
    key with another one of their page are decided in order.
    """
    ship_package(previous.sparkSession)
    history = {"seen_in_latest": "boolean", "first_detected_at": "timestamp", "last_detected_at": "timestamp"}
    new = detected.select(*MERGE_COLUMNS, *[F.lit(None).cast(t).alias(c) for c, t in history.items()])
    rows = previous.select(HISTORY_COLUMNS).withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))
    k = keyed(rows.repartition(*PAGE)).withColumn("shared", _shared())
    now = F.lit(analyzed_at)
    alone = k.filter("NOT shared")
    seen = F.when(F.col("is_new"), True).otherwise(F.lit(False) if mark_unseen else F.coalesce("seen_in_latest", F.lit(True)))
    alone = alone.withColumns({
        "seen_in_latest": seen,
        "first_detected_at": F.when(F.col("is_new"), now).otherwise(F.coalesce("first_detected_at", "last_detected_at", now)),
        "last_detected_at": F.when(F.col("is_new"), now).otherwise(F.col("last_detected_at")),
        "status": F.when(F.col("is_new"), F.coalesce("status", F.lit("open"))).otherwise(F.col("status"))}).select(HISTORY_COLUMNS)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        return typed(update_history(pdf[~pdf["is_new"]], pdf[pdf["is_new"]], analyzed_at, mark_unseen), HISTORY_COLUMNS)
    return alone.unionByName(_in_order(k.filter("shared"), decide, HISTORY_SCHEMA))
