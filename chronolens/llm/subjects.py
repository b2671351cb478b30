"""Subject areas from labelling functions and a model that learns their accuracy.

Documents are cut into sentences of hashed words once; that table is staged and
every later pass reads it. A lexicon of words and word pairs is learnt in Spark
counts: over the hand labelled documents, then twice over the sentences of all
documents, where a word counts by what the other words of its sentence say (its
own vote left out). Five functions vote on each sentence: words, word pairs, its
section, its document's source and the address the document names. A latent
model learns from the counts of agreement patterns how often each function is
right; it treats all subjects alike, so only which functions agree matters, and
five functions have at most 203 such patterns. The last three functions speak of
whole stretches of text and err together, so only the strongest of them enters a
posterior. A sentence that the lexicon finds to be about some subject adds its
posterior probabilities to its document's subjects, and a document has every
subject whose sum, to the nearest whole sentence, fills a given share of such
sentences.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolens.sources.shipping import ship
from chronolens.sources.staging import stage

#: Entries of a lexicon that are broadcast at once (16 bytes each); a larger one takes more passes.
LEXICON_PART = 1_000_000
#: A list of subjects is a taxonomy; more are refused, never cut.
SUBJECTS_MAX = 2_000
FUNCTIONS = ["words", "pairs", "section", "source", "address"]
CONTEXT = [2, 3, 4]
_ADDRESS = r"https?://[^\s/]+|\b[a-z]+-[0-9]{2,}[0-9a-z]*\b"
_SECTION, _SENTENCE, _WORD = re.compile(r"\n\s*\n|\n(?=#)"), re.compile(r"[.!?;]\s+|\n+"), re.compile(r"[\w-]+")


class _Hashes(dict):
    """64 bits for a word, each computed once in a task; emptied before it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        return h


def _mask(titles: list[str]) -> Callable[[str], str]:
    """Takes the subjects' own titles out of a lower-case text: they name folders and banners as
    often as matter. Words of a title may stand any white space apart, but not inside a word."""
    if not titles:
        return lambda text: text
    # no boundary in front: the first letters of the titles then tell where to look
    found = re.compile("(?:" + "|".join(r"\s+".join(re.escape(w) for w in t.lower().split()) for t in sorted(titles, key=len, reverse=True)) + r")(?![^\W_])")

    def blank(m: re.Match) -> str:
        return m.group() if m.start() and m.string[m.start() - 1].isalnum() else " "

    return lambda text: found.sub(blank, text)


_SENTENCES = "doc_id long, section int, sentence int, words array<long>"


def sentences(documents: DataFrame, titles: list[str]) -> DataFrame:
    """(doc_id, section, sentence, words): the hashed words of every sentence, in order.

    ``titles`` are taken out of the texts first. Null ids and texts have no sentences.
    """
    ship(documents.sparkSession)
    mask = _mask(titles)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            ids, sections, numbers, words, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                no = 0
                for section, body in enumerate(_SECTION.split(mask(text.lower().replace("_", " ")))):
                    for s in _SENTENCE.split(body):
                        if len(s) > 2:
                            words += [hashes[w] for w in _WORD.findall(s)]
                            ids.append(doc_id)
                            sections.append(section)
                            numbers.append(no)
                            ends.append(len(words))
                            no += 1
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sections, pa.int32()), pa.array(numbers, pa.int32()), lists], names=["doc_id", "section", "sentence", "words"])

    clean = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return clean.mapInArrow(cut, _SENTENCES)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a list column."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), lengths)


class Grams:
    """Distinct grams of the sentences of a batch: ``h`` the batch's gram hashes, each once, ``code``
    and ``row`` the place in ``h`` and the sentence of each occurrence, by row."""

    def __init__(self, h: np.ndarray, row: np.ndarray):
        coded = pa.array(h).dictionary_encode()  # by a hash table: nothing is sorted
        self.h, size = coded.dictionary.to_numpy(), max(len(coded.dictionary), 1)
        once = pc.unique(pa.array(row * size + coded.indices.to_numpy())).to_numpy()
        self.row, self.code = once // size, once % size


def grams_of(column: pa.Array) -> tuple[Grams, Grams]:
    """The words and the neighbouring word pairs of hashed sentences."""
    h, row = _lists(column)
    beside = np.flatnonzero(row[1:] == row[:-1])
    a, b = h[beside].view(np.uint64), h[beside + 1].view(np.uint64)
    mixed = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x165667B19E3779F9)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    return Grams(h, row), Grams(mixed.view(np.int64), row[beside])


class Lexicon:
    """Sorted gram hashes with subject number and weight."""

    def __init__(self, rows: pa.Table):
        h = rows.column("h").to_numpy()
        order = np.argsort(h)
        self.h = h[order]
        self.subject = rows.column("subject").to_numpy()[order].astype(np.int64)
        self.weight = rows.column("weight").to_numpy()[order]

    def find(self, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which occurrences are known, their subjects, their weights)."""
        if not len(self.h):
            return np.zeros(len(grams.row), bool), np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.h, grams.h), len(self.h) - 1)
        known = (self.h[at] == grams.h)[grams.code]
        entry = at[grams.code[known]]
        return known, self.subject[entry], self.weight[entry]

    def votes(self, grams: Grams, rows: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sums of each sentence by subject, known occurrences, their subjects, their weights)."""
        known, subject, weight = self.find(grams)
        return np.bincount(grams.row[known] * n + subject, weight, rows * n).astype(float).reshape(-1, n), known, subject, weight


class Parts:
    """A lexicon in parts small enough to broadcast one at a time: entries with h mod parts = p."""

    def __init__(self, rows: DataFrame, part: int = LEXICON_PART):
        self.rows, self.n = rows, max(1, -(-rows.count() // part))

    def __iter__(self) -> Iterator:
        context = ship(self.rows.sparkSession)
        for p in range(self.n):
            own = self.rows if self.n == 1 else self.rows.where(F.pmod("h", F.lit(self.n)) == p)
            yield p, context.broadcast(Lexicon(own.select("h", "subject", "weight").toArrow()))


_HITS = "doc_id long, section int, sentence int, pair boolean, subject int, weight double, hits int"


def said(grams: DataFrame, parts: Parts, n: int) -> DataFrame:
    """(doc_id, section, sentence, pair, subject, weight, hits): what the lexicon says of each
    sentence by its words and by its pairs, one row for each subject named."""
    out = None
    for _, shared in parts:

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lexicon = shared.value
            for batch in batches:
                for pair, grams in enumerate(grams_of(batch.column(3))):
                    known, subject, weight = lexicon.find(grams)
                    at, back = np.unique(grams.row[known] * n + subject, return_inverse=True)
                    take = pa.array(at // n)
                    weight, hits = np.bincount(back, weight, len(at)), np.bincount(back, minlength=len(at)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(take) for i in range(3)), pa.array(np.full(len(at), bool(pair))), pa.array((at % n).astype(np.int32)), pa.array(weight.astype(float)), pa.array(hits)],
                        names=["doc_id", "section", "sentence", "pair", "subject", "weight", "hits"],
                    )

        one = grams.mapInArrow(look, _HITS)
        out = one if out is None else out.unionByName(one)
    return out


def first_lexicon(documents: DataFrame, labels: DataFrame, titles: list[str], least: int = 3, share: float = 0.4) -> DataFrame:
    """(h, subject, weight) from the labelled documents; copies of a text count once.

    A gram must be labelled with its subject in ``share`` of its documents, and in
    clearly more than the subject's own part of all labels.
    """
    each = labels.groupBy("doc_id").agg(F.collect_set("subject").alias("of"))
    texts = documents.join(each, "doc_id").withColumn("__text", F.xxhash64("text")).dropDuplicates(["__text"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams in grams_of(batch.column(3)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(grams.row)), pa.array(grams.h[grams.code])], names=["doc_id", "h"])

    rows = sentences(texts, titles).mapInArrow(gather, "doc_id long, h long").distinct().join(each, "doc_id")
    rows = rows.select("h", F.explode("of").alias("subject"), (1.0 / F.size("of")).alias("w"))
    parts = each.select(F.explode("of").alias("subject"), (1.0 / F.size("of")).alias("w")).groupBy("subject").agg(F.sum("w").alias("w"))
    usual = parts.select("subject", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("usual"))  # one row a subject
    found = _best(rows.groupBy("h", "subject").agg(F.sum("w").alias("w")), least, share)
    return found.join(usual, "subject").where(F.col("part") >= F.col("usual") + 0.3 * (1 - F.col("usual"))).select("h", "subject", "weight")


def _best(counts: DataFrame, least: int, share: float, covered: float = 0.0) -> DataFrame:
    about = F.col("subject") >= 0
    ranked = F.reverse(F.array_sort(F.collect_list(F.when(about, F.struct("w", "subject")))))  # one for each subject
    most = counts.groupBy("h").agg(F.sum("w").alias("all"), F.sum(F.when(about, F.col("w"))).alias("n"), ranked.alias("r"))
    most = most.where((F.col("n") >= least) & (F.col("n") >= covered * F.col("all"))).select("h", "n", F.col("r")[0].alias("top"), F.coalesce(F.get("r", F.lit(1))["w"], F.lit(0.0)).alias("next"))
    part = F.col("top.w") / F.col("n")
    kept = most.where((part >= share) & (F.col("top.w") > 1.3 * F.col("next")))
    return kept.select("h", F.col("top.subject").cast("int").alias("subject"), F.log((part + 0.01) / (1.01 - part) * 10 + 1).alias("weight"), part.alias("part"))


def best_of(sums: np.ndarray) -> np.ndarray:
    """The subject with the largest sum of each row, -1 where nothing is said."""
    best = sums.argmax(1)
    return np.where(sums[np.arange(len(best)), best] > 1e-6, best, -1)


def second_lexicon(grams: DataFrame, first: DataFrame, n: int, least: int = 3, share: float = 0.8, covered: float = 0.5, part: int = LEXICON_PART) -> DataFrame:
    """The lexicon anew from all sentences, each gram judged by the others around it.

    A gram must stand in sentences about its subject (``share`` of those about any,
    ``covered`` of all), so words that sentences about nothing share stay out. A
    lexicon of one part gives each sentence's sums where the sentence lies; more
    parts first sum up what they say of a sentence, then each counts its own grams.
    """
    parts = Parts(first, part)
    rows, sums = grams, "array<double>"
    if parts.n > 1:
        each = said(grams, parts, n).groupBy("doc_id", "section", "sentence", "subject").agg(F.sum("weight").alias("w"))
        each = each.groupBy("doc_id", "section", "sentence").agg(F.map_from_entries(F.collect_list(F.struct("subject", "w"))).alias("m"))
        all_sums = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0.0)))
        rows = stage(grams.join(each, ["doc_id", "section", "sentence"], "left").select("doc_id", "section", "sentence", "words", F.coalesce(all_sums, F.array_repeat(F.lit(0.0), n)).cast(sums).alias("sums")), "sentence-sums")
    counts = None
    for p, shared in parts:

        def count(batches: Iterator[pa.RecordBatch], p=p, shared=shared, whole=parts.n) -> Iterator[pa.RecordBatch]:
            lexicon = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                both = grams_of(batch.column(3))
                seen = [lexicon.votes(grams, batch.num_rows, n) for grams in both]
                total = np.asarray(batch.column(4).flatten()).reshape(-1, n) if whole > 1 else seen[0][0] + seen[1][0]
                says = best_of(total)
                for grams, (_, known, subject, weight) in zip(both, seen):
                    best = says[grams.row]
                    others = total[grams.row[known]]  # without the gram's own vote
                    others[np.arange(len(others)), subject] -= weight
                    best[known] = best_of(others)
                    counted = np.bincount(grams.code * (n + 1) + best + 1, minlength=len(grams.h) * (n + 1))
                    keys = np.flatnonzero(counted)
                    h = grams.h[keys // (n + 1)]
                    own = h % whole == p  # the others are another pass's
                    yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array((keys % (n + 1) - 1)[own].astype(np.int32)), pa.array(counted[keys][own].astype(np.float64))], names=["h", "subject", "w"])

        one = rows.mapInArrow(count, "h long, subject int, w double")
        counts = one if counts is None else counts.unionByName(one)
    return _best(counts.groupBy("h", "subject").agg(F.sum("w").alias("w")), least, share, covered)


def lexicon_votes(grams: DataFrame, lexicon: DataFrame, n: int, part: int = LEXICON_PART) -> DataFrame:
    """(doc_id, section, words, pairs): subject numbers, one row for each sentence about any.

    A sentence is about something if two of its words or pairs stand in the lexicon;
    one word alone may be chance. Ties go to the smaller subject number.
    """
    parts = Parts(lexicon, part)
    if parts.n > 1:
        sums = said(grams, parts, n).groupBy("doc_id", "section", "sentence", "pair", "subject").agg(F.sum("weight").alias("w"), F.sum("hits").alias("hits"))
        top = lambda pair: (-F.max(F.when(F.col("pair") == pair, F.struct("w", (-F.col("subject")).alias("s"))))["s"]).cast("int")
        best = sums.groupBy("doc_id", "section", "sentence").agg(top(False).alias("words"), top(True).alias("pairs"), F.sum("hits").alias("hits"))
        return best.where("hits >= 2").select("doc_id", "section", "words", "pairs")
    shared = next(iter(parts))[1]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            hits, picked = np.zeros(batch.num_rows, np.int64), []
            for grams in grams_of(batch.column(3)):
                v, known, _, _ = lexicon.votes(grams, batch.num_rows, n)
                hits += np.bincount(grams.row[known], minlength=batch.num_rows)
                picked.append(pa.array(v.argmax(1).astype(np.int32), mask=v.max(1) <= 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *picked], names=["doc_id", "section", "words", "pairs"]).filter(pa.array(hits >= 2))

    return grams.mapInArrow(vote, "doc_id long, section int, words int, pairs int")


def _modal(df: DataFrame, keys: list[str], vote: str, out: str) -> DataFrame:
    """The most frequent ``vote`` of each key (ties: the smaller number)."""
    counts = df.where(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg((-F.max(F.struct("__n", (-F.col(vote)).alias("v")))["v"]).cast("int").alias(out))


def learn_accuracies(patterns: np.ndarray, counts: np.ndarray, n: int, rounds: int = 30) -> np.ndarray:
    """How often each function is right, by expectation maximisation over vote patterns
    (-1: no vote). ``patterns`` is a table of distinct patterns, not of sentences."""
    right = np.array([0.9, 0.95, 0.6, 0.3, 0.3])
    for _ in range(rounds):
        post = posterior(patterns, right, n)
        for j in range(patterns.shape[1]):
            said = patterns[:, j] >= 0
            if said.any():
                agree = post[np.flatnonzero(said), patterns[said, j]]
                right[j] = np.clip((agree @ counts[said] + 1) / (counts[said].sum() + 2), 1.5 / n, 0.9 if j in CONTEXT else 0.995)
    return right


def posterior(patterns: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    score, around = np.zeros((len(patterns), n)), np.zeros((len(patterns), n))
    for j, a in enumerate(right):
        said = np.flatnonzero(patterns[:, j] >= 0)
        at, gain = (said, patterns[said, j]), np.log(a * (n - 1) / (1 - a))
        if j in CONTEXT:
            around[at] = np.maximum(around[at], gain)
        else:
            score[at] += gain
    score += around
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


def _agreement(named: Column) -> Column:
    """Which functions agree, whatever the subject: each vote as its place in ``named``, -1 for none."""
    return F.array(*[F.coalesce(F.array_position(named, F.col(f)) - 1, F.lit(-1)).cast("int") for f in FUNCTIONS])


def assigned(votes: DataFrame, n: int, share: float) -> DataFrame:
    """(doc_id, subject, n_sentences, share) from (doc_id, FUNCTIONS, n): the model is learnt from
    the counts of agreement patterns (203 at most), posteriors are summed by document."""
    named = F.array_distinct(F.array_compact(F.array(*FUNCTIONS)))
    rows = stage(votes.withColumn("named", named).withColumn("pattern", _agreement(F.col("named"))).withColumn("about", F.sum("n").over(Window.partitionBy("doc_id"))).select("doc_id", "named", "pattern", "n", "about"), "vote-patterns")
    table = rows.groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    patterns = np.array(table.column("pattern").to_pylist(), np.int64).reshape(-1, len(FUNCTIONS))
    post = posterior(patterns, learn_accuracies(patterns, table.column("n").to_numpy().astype(float), n), n) if len(patterns) else np.zeros((0, n))
    learnt = rows.sparkSession.createDataFrame([([int(v) for v in p], [float(x) for x in q[: len(FUNCTIONS)]]) for p, q in zip(patterns, post)], "pattern array<int>, p array<double>")
    mass = rows.join(F.broadcast(learnt), "pattern").select("doc_id", "n", "about", F.posexplode("named").alias("place", "subject"), "p")
    summed = mass.groupBy("doc_id", "about", "subject").agg(F.sum(F.col("n") * F.get("p", F.col("place"))).alias("mass"))
    whole = F.floor(F.round("mass", 6) + 0.5)
    return summed.select("doc_id", "subject", whole.alias("n_sentences"), (whole / F.col("about")).alias("share")).where(F.col("share") >= share)


def subjects_of(documents: DataFrame, subjects: DataFrame, labels: DataFrame, share: float = 0.3, part: int = LEXICON_PART) -> DataFrame:
    """(doc_id, subject_code, n_sentences, share) of every subject that fills ``share``
    of a document's sentences about any subject.

    Null ids, null and empty texts and documents about nothing give no rows;
    labels of unknown documents or subjects are ignored; without any label there
    is nothing to learn from and no row. Copies are judged each for itself. Long
    texts are read whole. More than SUBJECTS_MAX subjects are an error.
    """
    spark = documents.sparkSession
    rows = subjects.where(F.col("subject_code").isNotNull()).select("subject_code", "title").distinct().limit(SUBJECTS_MAX + 1).collect()
    if len(rows) > SUBJECTS_MAX:
        raise ValueError(f"more than {SUBJECTS_MAX} subjects")
    codes, titles = sorted({r[0] for r in rows}), sorted({r[1].strip() for r in rows if r[1] and r[1].strip()})
    n = max(2, len(codes))
    numbers = spark.createDataFrame(list(enumerate(codes)) or [(0, "")], "subject int, subject_code string")
    docs = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "source")
    known = labels.join(numbers, "subject_code").select("doc_id", "subject").distinct()
    grams = stage(sentences(docs, titles), "sentences")
    lexicon = stage(first_lexicon(docs, known, titles), "lexicon")
    for _ in range(2):
        lexicon = stage(second_lexicon(grams, lexicon, n, part=part), "lexicon")
    votes = stage(lexicon_votes(grams, lexicon, n, part), "sentence-votes")

    each = votes.withColumn("own", F.coalesce("pairs", "words"))
    section = _modal(each, ["doc_id", "section"], "own", "section_vote")
    addressed = stage(docs.select("doc_id", "source", F.regexp_extract(F.coalesce("text", F.lit("")), _ADDRESS, 0).alias("address")), "addresses")
    labelled = known.join(addressed, "doc_id")
    source = _modal(labelled.where(F.col("source").isNotNull()), ["source"], "subject", "source_vote")
    address = _modal(labelled.where(F.col("address") != ""), ["address"], "subject", "address_vote")
    of_doc = addressed.join(source, "source", "left").join(address, "address", "left").groupBy("doc_id").agg(F.min("source_vote").alias("source"), F.min("address_vote").alias("address"))
    counted = each.groupBy("doc_id", "section", "words", "pairs").agg(F.count(F.lit(1)).alias("n"))
    full = counted.join(section, ["doc_id", "section"], "left").join(of_doc, "doc_id", "left").select("doc_id", "words", "pairs", F.col("section_vote").alias("section"), "source", "address", "n")
    found = assigned(full.groupBy("doc_id", *FUNCTIONS).agg(F.sum("n").alias("n")), n, share)
    return found.join(numbers, "subject").select("doc_id", "subject_code", "n_sentences", F.round("share", 6).alias("share"))
