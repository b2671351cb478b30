"""Personal information in free text: candidate spans, boosted trees, thresholds.

Generators with high recall propose overlapping spans of five kinds. Every span
is seen in two views. Its context says whether a form word stands before it, or a
word such as "build" that rules it out; its format is all else: digits, letters,
separators, what follows, and for persons how often its words are names. Boosted
trees are trained on the format alone, with labels from the context alone, on a
bounded sample of distinct texts, so they learn what the labels do not say. A
phone number, an identity number or an address is one if form words announce its
like, not words that rule out. Mail addresses and persons have hardly any such
words, so there the trees learn how likely a form word is before such a span, and
that likelihood is measured by what it is before announced ones: most items have no
form word, but what never has one is no item. Thresholds are calibrated on
texts kept from training. A span's score is its format's odds times those of its
context. Which words are names is counted over all rows in Spark: how often a word
stands where a form wants a name, against how often it stands anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.llm.boosting import BoostedTrees
from chronolens.sources.shipping import ship
from chronolens.sources.staging import stage

#: Distinct texts that the trees are trained on, at most about so many; names that are
#: broadcast: where there are more, each text is joined to those of its own words.
TRAINING_TEXTS, NAMES_PART = 6_000, 200_000

KINDS = ["email", "phone", "id_number", "address", "person"]
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

# Words of forms that announce an item, and words that rule one out.
BEFORE_NAME = ["Assignee", "signed by", "Employee", "cc", "From:", "To:", "call", "ship to", "reply from", "Rechnung an", "Re:", "Dear", "Contact:", "@"]
ANNOUNCES = {
    "email": r"(?:to:|from:|cc|contact=|mail:?|邮箱|<|;)",
    "phone": r"(?:tel\.?:?|mobile|office|phone[=:]?|call|fax:?|on|联系电话)",
    "id_number": r"(?:ssn:?|ni number|\bid|身份证|case|card|passport(?: no\.?)?|born \d{4},|steuer-id|dni)",
    "address": r"(?:address:|lives at|see you at|map of|ship to [^\n|]{3,40},|rechnung an [^\n|]{3,40},)",
    "person": r"(?:" + "|".join(re.escape(w.lower()) for w in BEFORE_NAME) + r")",
}
RULES_OUT = r"(?:build|ticket|sku|rev|uuid|row|of|version|release|chapter|step|article|issue|order|part|ip|pkg|x)"
_STREET = r"(?:street|st\.|avenue|ave|boulevard|blvd|road|rd|lane|terrace|crescent|cres\.|drive|court|square)"

_W = r"[^\W\d_][\w'’-]*"
_C = r"[A-ZÀ-ÖØ-Þ][\w'’]+"
_EMAIL = re.compile(r"[\w.+-]+(?: ?@ ?| ?\(at\) ?| ?\[at\] ?| at )[\w-]+(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[\w-]+)+", re.I)
_PHONE = re.compile(r"(?<![\w+(.-])(?:\+\d{1,3}[ -]?(?:\(0\) ?)?\d{1,4}(?:[ -]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|\d{2}(?:\.\d{2}){4}|\d{3}/\d{4,6}-\d{2,4}|\d{3} \d{4} \d{4}|\d{4} \d{3} \d{3}|\d{5} \d{6})(?![\w-])")
_ID = re.compile(r"(?<![\w.+-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{8}[A-Z]|\d{17}[\dX])(?![\w-])", re.I)
_ADDRESS = re.compile(rf"(?<![\w.:-])(?:\d{{1,4}}[a-z]? (?:rue {_W}|{_W}(?: {_W})? {_STREET})|{_W}(?:straße|strasse|weg|allee|gasse|platz) \d{{1,4}}[a-z]?\b|(?:calle|avenida|plaza|via) {_W} \d{{1,4}}\b)(?!\w)", re.I)
_REST = re.compile(rf",? (?:Apt \d+, )?(?:\d{{4,5}} )?{_C}(?: \d{{4,5}}\b)?")
_NAME = re.compile(rf"(?<![\w-])(?=((?:{_C}(?:-{_C})?|[A-Z]\.) (?:[A-Z]\. )?{_C}(?![\w-])|{_C}, (?:{_C}(?:-{_C})?(?![\w-])|[A-Z]\.)))")
_BEFORE = {k: re.compile(p + r"\s*$", re.I) for k, p in ANNOUNCES.items()}
_OUT = re.compile(r"\b" + RULES_OUT + r"\s*$", re.I)
_WIDE = {0xFF10 + i: ord("0") + i for i in range(10)}
_WORD_IN_NAME = re.compile(r"[\w'’]+")

CUE = 1
#: Columns of a description that are the format's view: neither what labels it nor where its line starts.
FORMAT = [0, *range(2, 16), 17, 18]
#: What may tell a mail address: groups, whether it ends in letters, dots; and a person: how often
#: its words are names, a comma, an initial, capitals. Form words stand before such spans whatever
#: follows and however they are written, so the rest must not count.
SEEN = {"email": [0, 5, 14, 15], "person": [0, 8, 9, 10, 11, 12, 17, 18]}
#: Kinds whose labels are "a form word stands before it" or not, as hardly a word rules them out;
#: part of the announced spans whose likelihood an item may fall short of by half.
SELDOM_RULED_OUT, SHORT_OF = {"email", "person"}, 0.05
#: Odds that a form word before a span lends it; one that rules it out takes as much. To kinds
#: whose trees have learnt form words it lends nothing more.
CONTEXT_ODDS = 20.0


def name_counts(texts: DataFrame, least: int = 2, part: float = 0.12) -> DataFrame:
    """(w, a, b): share of a word's capitalised occurrences in which it is the first or last name after a form word."""
    cue = "(?:" + "|".join(re.escape(w) for w in BEFORE_NAME) + r")\s*"
    named = rf"{cue}((?:\p{{Lu}}\.|\p{{Lu}}\p{{Ll}}{{2,}}(?:-\p{{Lu}}\p{{Ll}}+)?) (?:\p{{Lu}}\. )?\p{{Lu}}\p{{Ll}}{{2,}})"
    find = lambda pattern, group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    role = lambda words, r: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(r).alias("r")))
    rows = texts.select(find(r"(?<!\p{L})\p{Lu}\p{Ll}{2,}", 0).alias("every"), find(named, 1).alias("named"))
    firsts = F.transform("named", lambda m: F.substring_index(F.substring_index(m, " ", 1), "-", 1))
    lasts = F.transform("named", lambda m: F.substring_index(m, " ", -1))
    words = rows.select(F.explode(F.concat(role(F.col("every"), 0), role(firsts, 1), role(lasts, 2))).alias("x")).select("x.w", "x.r")
    counts = words.groupBy(F.lower("w").alias("w")).agg(*(F.count(F.when(F.col("r") == r, 1)).alias(n) for r, n in enumerate(("n", "a", "b"))))
    named_often = (F.col("a") + F.col("b") >= least) & ((F.col("a") + F.col("b")) >= part * F.col("n"))
    return counts.where(named_often).select("w", (F.col("a") / F.greatest("n", F.lit(1))).alias("a"), (F.col("b") / F.greatest("n", F.lit(1))).alias("b"))


def _table(names: pa.Table) -> dict[str, tuple[float, float]]:
    return {w: (a, b) for w, a, b in zip(*(names.column(c).to_pylist() for c in ("w", "a", "b")))}


def _own_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with ``__names``: those of the text's words that are names, with their shares."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_'’]+"), F.lit(0)))
    each = rows.where(F.col("text").isNotNull()).select("text").distinct().select("text", F.explode(words).alias("w"))
    own = each.join(names, "w").groupBy("text").agg(F.collect_list(F.struct("w", "a", "b")).alias("__names"))
    return rows.join(own, "text", "left")


def _around(text: str, kind: str, start: int) -> int:
    before = text[max(0, start - 60) : start] if kind == "address" else text[max(0, start - 24) : start]
    if _BEFORE[kind].search(before):
        return 1
    return -1 if _OUT.search(before) else 0


def _describe(text: str, kind: str, start: int, end: int, names: dict) -> list[float]:
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    groups = re.split(r"\W+", span.strip("+("))
    after = text[end : end + 1]
    first = last = swapped = 0.0
    if kind == "person":
        parts = [p.lower() for p in _WORD_IN_NAME.findall(span)]
        comma = "," in span
        own = parts[1:] if comma else parts[:-1]
        family = parts[0] if comma else parts[-1]
        known = [names.get(p, (0.0, 0.0)) for p in own if len(p) > 1]
        first = min((k[0] for k in known), default=0.5)
        last = names.get(family, (0.0, 0.0))[1]
        swapped = max((k[1] for k in known), default=0.0) + names.get(family, (0.0, 0.0))[0]
    tail = groups[-1]
    return [
        KINDS.index(kind), _around(text, kind, start), digits, letters, end - start, len(groups), span[0] in "+(", len(groups) > 1 and groups[0] == groups[1],
        first, last, "," in span, bool(re.search(r"\b[A-Z]\.", span)), span.isupper(), 0 if after in "\n" else 1 if after == " " else 2 if after.isalnum() else 3,
        tail.isalpha() and len(tail) > 1, span.count("."), start == 0 or text[start - 1] == "\n", min(first, last), swapped,
    ]


def propose(text: str, names: dict, every: bool = False) -> Iterator[tuple[str, int, int]]:
    """Overlapping candidate spans of all kinds; more than will be kept. With ``every`` a
    person may be any two capitalised words, else a name or a form word must be there."""
    plain = text if text.isascii() else text.translate(_WIDE)
    if "@" in plain or "at" in plain:
        low = plain.lower()
        if "@" in plain or "(at)" in low or "[at]" in low or " dot " in low:
            for m in _EMAIL.finditer(plain):
                yield "email", m.start(), m.end()
    for m in _PHONE.finditer(plain):
        yield "phone", m.start(), m.end()
    for m in _ID.finditer(plain):
        yield "id_number", m.start(), m.end()
    for m in _ADDRESS.finditer(plain):
        rest = _REST.match(plain, m.end())
        yield "address", m.start(), rest.end() if rest else m.end()
    named = plain.title() if plain.islower() else plain
    if len(named) == len(plain):
        for m in _NAME.finditer(named):
            span = m.group(1)
            known = [w for w in _WORD_IN_NAME.findall(span.lower()) if w in names]
            if known or every or _BEFORE["person"].search(plain[max(0, m.start() - 24) : m.start()]):
                yield "person", m.start(), m.start() + len(span)


def format_view(x: np.ndarray) -> np.ndarray:
    """The columns of descriptions that trees see."""
    shown = x.copy()
    for kind, columns in SEEN.items():
        other = [j for j in range(x.shape[1]) if j not in columns]
        shown[np.ix_(x[:, 0] == KINDS.index(kind), other)] = 0
    return shown[:, FORMAT]


class Detector:
    """Names, trees and thresholds; finds spans in one text or many. ``names`` holds all
    names, or is empty where ``table`` does and each text brings its own."""

    def __init__(self, names: dict, trees: BoostedTrees, thresholds: dict[str, float], usual: dict[str, float] | None = None):
        self.names, self.trees, self.thresholds, self.usual = names, trees, thresholds, usual or {}
        self.held_out: dict[str, tuple[int, float, float]] = {}  # kind: (labelled spans, recall, precision)

    def format_scores(self, x: np.ndarray) -> np.ndarray:
        """How likely each description's format is an item's."""
        p = self.trees.predict(format_view(x))
        usual = np.array([self.usual.get(k, 1.0) for k in KINDS])[x[:, 0].astype(int)]
        return np.clip(p / usual, 0.001, 0.999)

    def scores(self, x: np.ndarray) -> np.ndarray:
        p = self.format_scores(x)
        learnt = np.isin(x[:, 0], [KINDS.index(k) for k in SELDOM_RULED_OUT])
        odds = p / (1 - p) * CONTEXT_ODDS ** np.where(learnt, np.minimum(x[:, CUE], 0), x[:, CUE])
        return odds / (1 + odds)

    def find(self, texts: list[str | None], own: list | None = None) -> list[list[tuple[int, int, str]]]:
        where, rows = [], []
        for i, text in enumerate(texts):
            if text:
                plain = text if text.isascii() else text.translate(_WIDE)
                names = self.names if own is None else {n["w"]: (n["a"], n["b"]) for n in own[i] or []}
                for kind, start, end in propose(text, names):
                    where.append((i, start, end, kind))
                    rows.append(_describe(plain, kind, start, end, names))
        out: list[list] = [[] for _ in texts]
        if not rows:
            return out
        scores = self.scores(np.array(rows, float))
        held: tuple | None = None
        for s, (i, start, end, kind) in sorted(zip(scores, where), key=lambda x: (x[1][0], x[1][1], -x[1][2], -x[0])):
            if s < self.thresholds[kind]:
                continue
            if held and held[0] == i and start < held[2]:
                if s > held[4] + 0.2:  # a much surer span takes the place of an earlier one
                    out[i].pop()
                else:
                    continue
            out[i].append((start, end, kind))
            held = (i, start, end, kind, s)
        return out


def train(sample: list[str], names: dict) -> Detector:
    """Fit the trees on the format of spans that their context labels; calibrate on texts
    that a hash keeps from training. ``sample`` has distinct texts."""
    x, y, held = [], [], []
    for text in sample:
        plain = text if text.isascii() else text.translate(_WIDE)
        kept = crc32(text.encode("utf-8", "surrogatepass")) % 5 == 0
        for kind, start, end in propose(text, names, every=True):  # what a form word made a candidate would always have one
            row = _describe(plain, kind, start, end, names)
            if row[CUE] or kind in SELDOM_RULED_OUT:
                x.append(row)
                y.append(row[CUE] == 1)
                held.append(kept)
    if not x or len(set(y)) < 2:
        return Detector(names, BoostedTrees(), {k: 0.5 for k in KINDS} if x and y[0] else {k: 1.1 for k in KINDS})
    x, y, held = np.array(x, float), np.array(y, float), np.array(held)
    if held.all() or not held.any():
        held = np.zeros(len(y), bool)
    trees = BoostedTrees().fit(format_view(x[~held]), y[~held])
    found = Detector(names, trees, dict.fromkeys(KINDS, 0.5))
    raw = trees.predict(format_view(x))
    for k, kind in enumerate(KINDS):
        own = held & (x[:, 0] == k) if (held & (x[:, 0] == k)).sum() >= 30 else x[:, 0] == k
        if kind in SELDOM_RULED_OUT:
            if (y[own] == 1).any():
                found.usual[kind] = float(np.clip(np.quantile(raw[own & (y == 1)], SHORT_OF), 0.05, 1.0))
        elif own.sum() >= 30 and len(set(y[own])) == 2:
            p = found.format_scores(x[own])
            tried = np.linspace(0.2, 0.8, 25)
            f1 = np.array([2 * (y[own][p >= t]).sum() / ((p >= t).sum() + y[own].sum()) for t in tried])
            good = tried[f1 >= f1.max() - 0.005]  # as good as the best; the most even-handed of them
            found.thresholds[kind] = float(good[np.argmin(np.abs(good - 0.5))])
        sure = found.format_scores(x[own]) >= found.thresholds[kind] if own.any() else np.zeros(0, bool)
        told = y[own] if kind not in SELDOM_RULED_OUT else np.where(y[own] == 1, 1, sure)  # spans without a form word say nothing
        found.held_out[kind] = (int((y[own] == 1).sum()), float(sure[told == 1].mean()) if (told == 1).any() else 0.0, float(told[sure].mean()) if sure.any() else 0.0)
    return found


def detector(texts: DataFrame) -> tuple[Detector, DataFrame | None]:
    """Count names over all of ``texts`` (text), train on a bounded hash sample of the distinct ones.

    The second value is the table of names where they are too many to broadcast.
    """
    own = texts.where(F.length(F.trim("text")) > 0)
    names = stage(name_counts(own), "names")
    step = max(1, own.count() // TRAINING_TEXTS)
    sample = own.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(2 * TRAINING_TEXTS)
    if names.count() <= NAMES_PART:
        return train(sorted(sample.toArrow().column("text").to_pylist()), _table(names.toArrow())), None
    with_names = _own_names(sample, names).toArrow().to_pylist()
    known = {n["w"]: (n["a"], n["b"]) for r in with_names for n in r["__names"] or []}
    found = train(sorted(r["text"] for r in with_names), known)
    found.names = {}
    return found, names


def _prepared(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    return rows.withColumn("__names", F.lit(None).cast("array<struct<w: string, a: double, b: double>>")) if names is None else _own_names(rows, names)


def spans(rows: DataFrame, found: Detector, names: DataFrame | None = None) -> DataFrame:
    """(…keys, kind, start_pos, end_pos): one row for each item in ``rows`` (…keys, text).

    ``found`` and ``names`` come from ``detector``. Positions are 0-based character
    offsets of the text as stored. Null and empty texts have no items; long texts are
    read whole; repeated rows repeat. Columns besides text are passed through, except
    that the result's own names replace columns of the same name.
    """
    shared, joined = ship(rows.sparkSession).broadcast(found), names is not None
    keys = [c for c in rows.columns if c not in ("text", "kind", "start_pos", "end_pos")]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), "kind string", "start_pos long", "end_pos long"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            each = shared.value.find(column("text").to_pylist(), column("__names").to_pylist() if joined else None)
            at = np.repeat(np.arange(batch.num_rows), [len(e) for e in each])
            flat = [s for e in each for s in e]
            kept = [column(c).take(pa.array(at)) for c in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([s[2] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int64()), pa.array([s[1] for s in flat], pa.int64())], names=[*keys, "kind", "start_pos", "end_pos"])

    return _prepared(rows, names).mapInArrow(search, schema)


def redact(rows: DataFrame, found: Detector, names: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``text`` redacted: typed placeholders, all else unchanged; null stays null."""
    shared, joined = ship(rows.sparkSession).broadcast(found), names is not None
    columns = rows.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            texts = column("text").to_pylist()
            out = []
            for text, items in zip(texts, shared.value.find(texts, column("__names").to_pylist() if joined else None)):
                for start, end, kind in reversed(items):
                    text = text[:start] + PLACEHOLDERS[kind] + text[end:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else column(n) for n in columns], names=columns)

    return _prepared(rows, names).mapInArrow(clean, rows.schema)
