"""Ranked lexical search with hashed max-sketches: upper bounds choose which documents are scored exactly.

A term adds weight * impact to a score, and its impact grows with the term's count in the
document. A document's sketch keeps, for each coordinate that its terms hash to, the largest
count and so the largest impact of them. Summing weight * impact over the coordinates of an
item's terms never gives less than the score. Sketches do not depend on the items; texts
are read again only for documents whose bound reaches the score to beat.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import quoted, stored, text_or_empty, word_blocks

# What a term is made of, as a pattern and for the bytes of UTF-8.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

COORDINATES = 1 << 16
# Counts in a sketch are bytes; this one stands for itself and everything above.
MANY = 255
# No impact reaches this: (1000000000 * count) div (1000 * count + ...).
IMPACT_LIMIT = 1_000_000


@dataclass(frozen=True)
class LexicalSettings:
    k: int = 10
    first: int = 20  # documents an item scores exactly to find the score to beat
    terms_at_once: int = 1 << 19  # terms of items that one pass over the sketches looks up
    items_at_once: int = 256  # columns of a table of weights


def term_counts(text: bytes) -> tuple[Counter, int]:
    """The terms of a whole text in UTF-8 with their counts, and how many there are with repeats."""
    counts: Counter = Counter()
    for words in word_blocks(text.translate(TERM_BYTES)):
        counts.update(words)
    return counts, counts.total()


def coordinate(term: bytes) -> int:
    return zlib.crc32(term) % COORDINATES


def sketch(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Ascending coordinates of the terms and the largest count at each, at most ``MANY``."""
    at = np.fromiter(map(coordinate, counts), np.uint16, len(counts))
    n = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), MANY).astype(np.uint8)
    if not len(at):
        return at, n
    order = np.argsort(at, kind="stable")
    places, starts = np.unique(at[order], return_index=True)
    return places, np.maximum.reduceat(n[order], starts)


def impacts(counts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a term with so many occurrences adds per weight; ``length`` is the document's m."""
    return 1_000_000_000 * counts // (1000 * counts + 8 * length)


def normal_length(n: np.ndarray | int, corpus: Corpus) -> np.ndarray | int:
    """m: 100 for a document of average length, at least 10."""
    return 100 - 90 + 90 * n * corpus.documents // corpus.terms


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all terms with repeats."""

    documents: int
    terms: int


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats) and the sketch of every document with a term; stored, one row each."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                lengths, places, counts = [], [], []
                for value in part.column("text"):
                    terms, n = term_counts(value.as_py())
                    at, most = sketch(terms)
                    lengths.append(n)
                    places.append(at.astype("<u2").tobytes())
                    counts.append(most.tobytes())
                columns = [part.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())]
                made = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "places", "counts"])
                yield made.filter(pa.array([n > 0 for n in lengths], pa.bool_()))

    rows = docs.select(F.col(quoted(id_column)).cast("bigint").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    return stored(rows.mapInArrow(sketches, "doc_id bigint, n bigint, places binary, counts binary"), "max_sketches")


def item_terms(items: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term: the different terms of each item; an item given by several rows has the terms of all."""
    lowered = F.translate(text_or_empty(text), CAPITALS, SMALL)
    term = F.explode(F.regexp_extract_all(lowered, F.lit(TERM_PATTERN), F.lit(0)))
    return items.select(F.col(quoted(id_column)).alias("item_id"), term.alias("term")).distinct()


@dataclass(frozen=True)
class Questions:
    """Items of one pass: their terms (places in ``terms``) and the weights of these."""

    ids: list
    terms: list[bytes]
    weights: np.ndarray  # by term
    members: list[np.ndarray]  # by item: places of its terms
    corpus: Corpus
    settings: LexicalSettings

    def tables(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Per run of items: the coordinates that their terms have and the weights, coordinates x items."""
        at = np.array([coordinate(t) for t in self.terms], np.int64)
        for start in range(0, len(self.ids), self.settings.items_at_once):
            members = self.members[start : start + self.settings.items_at_once]
            places, spots = np.unique(at[np.concatenate(members)], return_inverse=True)
            table = np.zeros((len(places), len(members)))
            owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
            np.add.at(table, (spots, owner), self.weights[np.concatenate(members)])
            yield slice(start, start + len(members)), places, table

    def bounds(self, batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First item of a run, ids of some documents, and upper bounds of their scores, documents x items.

        Sums stay below 2 ** 53, so doubles hold them exactly. Documents without an id are left out.
        """
        tables = list(self.tables())
        spot_of = []
        for _, places, _ in tables:
            spots = np.full(COORDINATES, -1, np.int64)
            spots[places] = np.arange(len(places))
            spot_of.append(spots)
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            for start in range(0, len(batch), rows):
                part = batch.slice(start, rows)
                ids = part.column("doc_id").to_numpy()
                lengths = normal_length(part.column("n").to_numpy(), self.corpus)
                places = part.column("places").to_pylist()
                at = np.frombuffer(b"".join(places), "<u2")
                counts = np.frombuffer(b"".join(part.column("counts").to_pylist()), np.uint8).astype(np.int64)
                owner = np.repeat(np.arange(len(ids)), [len(p) // 2 for p in places])
                impact = np.where(counts == MANY, IMPACT_LIMIT, impacts(counts, lengths[owner]))
                for (run, own, table), spots in zip(tables, spot_of):
                    spot = spots[at]
                    there = spot >= 0
                    found = np.zeros((len(ids), len(own)))
                    found[owner[there], spot[there]] = impact[there]
                    yield run.start, ids, found @ table

    def scores(self, text: bytes, items: list[int], known: dict[bytes, int]) -> list[int]:
        """Exact scores of a whole text for some items; ``known`` tells the places of terms."""
        counts, n = term_counts(text)
        shared = [(known[t], c) for t, c in counts.items() if t in known] if n else []
        impact = np.zeros(len(self.terms), np.int64)
        if shared:
            places, found = np.array(shared, np.int64).T
            impact[places] = impacts(found, normal_length(n, self.corpus))
        return [int((impact[m] * self.weights[m]).sum()) for m in (self.members[i] for i in items)]


def document_counts(docs: DataFrame, terms: list[bytes], text: str = "text") -> np.ndarray:
    """In how many documents each of some terms stands, counted over all documents."""
    known = {t: i for i, t in enumerate(terms)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(known), np.int64)
        for batch in batches:
            for value in batch.column("text"):
                words: set = set()
                for block in word_blocks(value.as_py().translate(TERM_BYTES)):
                    words.update(block)
                found[[known[w] for w in words if w in known]] += 1
        there = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"place": pa.array(there, pa.int64()), "n": pa.array(found[there], pa.int64())})

    partial = docs.select(text_or_empty(text).cast("binary").alias("text")).mapInArrow(count, "place bigint, n bigint")
    made = np.zeros(len(terms), np.int64)
    # At most one row per term.
    for row in partial.groupBy("place").agg(F.sum("n").alias("n")).collect():
        made[row["place"]] = row["n"]
    return made


def ask(docs: DataFrame, asked: pd.DataFrame, corpus: Corpus, settings: LexicalSettings, text: str) -> Questions:
    """The items of ``asked`` (item_id, term) with the weights of their terms."""
    terms = sorted({t.encode() for t in asked["term"]})
    place = {t: i for i, t in enumerate(terms)}
    df = document_counts(docs, terms, text)
    weights = np.floor(1000 * np.log((2 * corpus.documents + 2) / (2 * df + 1))).astype(np.int64)
    members: dict = {}
    for item, term in zip(asked["item_id"], asked["term"]):
        members.setdefault(item, []).append(place[term.encode()])
    return Questions(list(members), terms, weights, [np.sort(m) for m in members.values()], corpus, settings)


class Best:
    """The ``k`` best of each item: greatest score first, then the smallest document id."""

    def __init__(self, k: int, beat: dict[int, tuple[int, int]]) -> None:
        self.k, self.beat = k, dict(beat)
        self.found: dict[int, list[tuple[int, int]]] = {}

    def reaches(self, item: int, bound: float, doc: int) -> bool:
        """Whether a document with this bound may be among the best."""
        return bound > 0 and (item not in self.beat or (-bound, doc) <= self.beat[item])

    def add(self, item: int, score: int, doc: int) -> None:
        if score > 0 and self.reaches(item, score, doc):
            best = self.found.setdefault(item, [])
            best.append((-score, doc))
            if len(best) >= self.k:
                best.sort()
                del best[self.k :]
                self.beat[item] = min(best[-1], self.beat.get(item, best[-1]))


def first_candidates(index: DataFrame, asked: Questions) -> DataFrame:
    """item (its place), doc_id: for each item the documents of greatest bounds, at most ``first``."""
    most = asked.settings.first

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for start, ids, bounds in asked.bounds(batches):
            names = np.broadcast_to(ids[:, None], bounds.shape)
            if start in held:
                bounds, names = np.concatenate([held[start][0], bounds]), np.concatenate([held[start][1], names])
            if len(bounds) > most:
                best = np.argpartition(-bounds, most - 1, axis=0)[:most]
                bounds, names = np.take_along_axis(bounds, best, 0), np.take_along_axis(names, best, 0)
            held[start] = bounds, names
        for start, (bounds, names) in held.items():
            rows, items = np.nonzero(bounds)
            columns = [pa.array(items + start, pa.int64()), pa.array(names[rows, items], pa.int64()), pa.array(bounds[rows, items], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "bound"])

    found = index.select("doc_id", "n", "places", "counts").mapInArrow(top, "item bigint, doc_id bigint, bound double")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id"))
    return found.withColumn("place", place).where(F.col("place") <= most)


def candidates(index: DataFrame, asked: Questions, beat: dict[int, tuple[int, int]]) -> DataFrame:
    """doc_id with the items (places) whose score to beat its bounds reach, and these bounds."""

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = np.ones(len(asked.ids))
        names = np.full(len(asked.ids), np.iinfo(np.int64).max)
        for item, (score, doc) in beat.items():
            scores[item], names[item] = -score, doc
        for start, ids, bounds in asked.bounds(batches):
            own = slice(start, start + bounds.shape[1])
            reached = (bounds > scores[own]) | ((bounds == scores[own]) & (ids[:, None] <= names[own]))
            rows, items = np.nonzero(reached)
            some = np.flatnonzero(reached.any(axis=1))
            offsets = np.append(np.searchsorted(rows, some), len(rows)).astype(np.int32)
            columns = [
                pa.array(ids[some], pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(items + start, pa.int64())),
                pa.ListArray.from_arrays(offsets, pa.array(bounds[rows, items], pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "items", "bounds"])

    return index.select("doc_id", "n", "places", "counts").mapInArrow(
        reaching, "doc_id bigint, items array<bigint>, bounds array<double>"
    )


def rescore(texts: DataFrame, asked: Questions, beat: dict[int, tuple[int, int]]) -> DataFrame:
    """item (its place), doc_id, score: exact scores of ``texts`` (doc_id, text, items, bounds), the best of each task.

    Documents are taken by descending bound. One whose bounds no longer reach the
    score to beat, which rises as a task goes on, is not read.
    """
    k = asked.settings.k

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(asked.terms)}
        best = Best(k, beat)
        for batch in batches:
            ids, items, bounds = (batch.column(c).to_pylist() for c in ("doc_id", "items", "bounds"))
            for row in sorted(range(len(ids)), key=lambda i: -max(bounds[i])):
                wanted = sorted({i for i, b in zip(items[row], bounds[row]) if best.reaches(i, b, ids[row])})
                if wanted:
                    for item, score in zip(wanted, asked.scores(batch.column("text")[row].as_py(), wanted, known)):
                        best.add(item, score, ids[row])
        found = [(item, doc, -score) for item, rows in best.found.items() for score, doc in sorted(rows)[:k]]
        columns = zip(*found) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return texts.mapInArrow(exact, "item bigint, doc_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    settings: LexicalSettings = LexicalSettings(),
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each item.

    Equal scores rank by ascending doc_id. Every row of ``docs`` is a document: repeated
    rows rank one after the other, and rows without an id count in all statistics but
    are never returned. Null and empty texts, and those without a term, are no
    documents; an item without a term, or empty tables, give no rows. Rows of
    ``items`` with the same id are one item; a null id is an item like others. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_column, text)
    totals = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    asked = stored(item_terms(items, item_column, text), "item_terms")
    schema = f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint"
    answers = spark.createDataFrame([], schema)
    if not totals["documents"]:
        return answers
    corpus = Corpus(totals["documents"], totals["terms"])
    # All items of a pass, with their terms, are held by the driver and by each task: so many terms at most.
    n_passes = max(1, -(-asked.count() // settings.terms_at_once))
    for turn in range(n_passes):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_passes)) == turn).orderBy("item_id", "term").collect()
        if part:
            answers = answers.union(_pass(docs, index, pd.DataFrame(part, columns=["item_id", "term"], dtype=object), corpus, settings, schema, id_column, text))
    return answers


def _pass(
    docs: DataFrame, index: DataFrame, asked: pd.DataFrame, corpus: Corpus, settings: LexicalSettings, schema: str, id_column: str, text: str
) -> DataFrame:
    spark = docs.sparkSession
    questions = ask(docs, asked, corpus, settings, text)
    texts = docs.select(F.col(quoted(id_column)).cast("bigint").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    first = first_candidates(index, questions).groupBy("doc_id").agg(
        F.collect_set("item").alias("items"), F.collect_list("bound").alias("bounds")
    )
    # At most ``first`` documents per item of the pass.
    first = stored(first.withColumn("bounds", F.transform("items", lambda _: F.array_max("bounds"))), "first_candidates")
    tried = rescore(texts.join(F.broadcast(first), "doc_id"), questions, {})
    beat = {}
    for row in _best(tried, settings.k).where(F.col("rank") == settings.k).collect():
        beat[row["item"]] = -row["score"], row["doc_id"]
    # Several rows may have one id; each is scored for the items that any of them reaches.
    left = candidates(index, questions, beat).groupBy("doc_id").agg(
        F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("bounds")).alias("bounds")
    )
    found = _best(rescore(texts.join(stored(left, "candidates"), "doc_id"), questions, beat), settings.k)
    names = spark.createDataFrame(list(enumerate(questions.ids)), f"item bigint, {schema.split(',')[0]}")
    return stored(found, "ranked").join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
