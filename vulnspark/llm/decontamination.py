"""Benchmark decontamination with BM25 and block-max WAND.

The test items are indexed by their words: a posting holds the BM25 weight of the word in the
item as a share of the item's own full score, so one threshold serves all items. How many items hold
a word, the mean length and the longest item are counted over the whole benchmark by Spark, so no
result depends on how the items are cut into indexes. Every passage
of every document is a query; a passage is two neighbouring blocks of as many words as the
longest item has, so that any copy of an item lies whole in one passage. Passages whose words'
upper block maxima cannot reach the threshold are passed over for the items of that block, as in
block-max WAND, here for all passages of a document at once; the items of the other blocks are
scored, and what is retrieved must hold the word sequences of question and answer.

Indexes of at most `ITEMS` items and about `WORDS` words are built in tasks; each is broadcast for
one pass over the documents.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import Store, rows, text_of

THRESHOLD = 0.6
OVERLAP = 0.6
GRAM = 3
#: Items below so many words count only as a whole.
SHORT = 8
#: Items and words of one index: about 240 MB while it is built in a task. They change what is read when, no result.
ITEMS = 5_000
WORDS = 500_000
#: Answers below so many words are also compared word by word, for one changed word breaks most of
#: their sequences.
SHORT_ANSWER = 8
#: Items to a block of the index.
BLOCK = 4
LEAST = 0.05
CELLS = 500_000
K1, B = 1.2, 0.75
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; of a single sentence its last quarter."""
    sentences = [w for s in SENTENCE.split(text) if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Item:
    item_id: int
    size: int
    question: set
    answer: set
    whole: tuple | None
    answer_words: frozenset = frozenset()

    @classmethod
    def of(cls, item_id: int, text: str) -> Item:
        words = words_of(text)
        question, answer = question_and_answer(text)
        whole = tuple(words) if len(words) < SHORT else None
        single = frozenset(answer) if len(answer) < SHORT_ANSWER else frozenset()
        return cls(item_id, len(words), grams(question, GRAM), grams(answer, GRAM), whole, single)

    def overlaps(self, words: list[str]) -> tuple[float, float]:
        """Shares of the question's and the answer's word sequences that the passage holds; of a
        short answer the share of its words, if that is greater."""
        if self.whole:
            found = float(self.whole in grams(words, self.size))
            return found, found
        share = lambda own: sum(g in held[len(g)] for g in own) / len(own) if own else 1.0
        held = {n: grams(words, n) for n in {len(g) for g in self.question | self.answer}}
        answer = share(self.answer)
        if self.answer_words and answer < 1.0:
            answer = max(answer, len(self.answer_words & set(words)) / len(self.answer_words))
        return share(self.question), answer


@dataclass
class Benchmark:
    """Counts over all test items: their number and words, the longest, and the items of each word."""

    items: int
    words: int
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, texts: list[tuple[int, str]]) -> Benchmark:
        bags = [words_of(t) for _, t in texts]
        df = Counter(w for bag in bags for w in set(bag))
        return cls(len(bags), sum(map(len, bags)), max(map(len, bags), default=0), dict(df))


class Index:
    """BM25 postings of the items' words; weights are shares of the item's full score.

    Items are numbered by size and taken in blocks of `BLOCK`; a word keeps its largest weight
    in each block it occurs in (the block maxima of WAND). Words common to most items weigh
    `LEAST`."""

    def __init__(self, texts: list[tuple[int, str]], whole: Benchmark | None = None):
        whole = whole or Benchmark.of(texts)
        texts = sorted(texts, key=lambda x: (len(words_of(x[1])), x[0]))
        self.items = [Item.of(i, t) for i, t in texts]
        bags = [Counter(words_of(t)) for _, t in texts]
        self.longest = whole.longest
        mean = max(1, whole.words / max(1, whole.items))
        df = {w: whole.df[w] for w in dict.fromkeys(w for bag in bags for w in bag)}
        idf = {w: max(LEAST, math.log((whole.items - n + 0.5) / (n + 0.5))) for w, n in df.items()}
        self.number = {w: k for k, w in enumerate(df)}
        most: dict[tuple[int, int], float] = {}
        self.postings: list[tuple[np.ndarray, np.ndarray]] = []
        for i, bag in enumerate(bags):
            norm = K1 * (1 - B + B * self.items[i].size / mean)
            weight = np.array([idf[w] * n * (K1 + 1) / (n + norm) for w, n in bag.items()])
            numbers = np.array([self.number[w] for w in bag], np.int64)
            weight /= weight.sum()
            self.postings.append((numbers, weight))
            for k, x in zip(numbers.tolist(), weight.tolist(), strict=True):
                key = (k, i // BLOCK)
                most[key] = max(most.get(key, 0.0), x)
        keys = sorted(most)
        self.n_blocks = -(-len(self.items) // BLOCK)
        self.block = np.array([k[1] for k in keys], np.int64)
        self.block_max = np.array([most[k] for k in keys])
        self.first = np.searchsorted([k[0] for k in keys], np.arange(len(df) + 1))

    def packed(self) -> bytes:
        """The index as plain values."""
        plain = {k: v for k, v in vars(self).items() if k != "items"}
        return pickle.dumps((plain, [(*vars(item).values(),) for item in self.items]))

    @classmethod
    def unpacked(cls, data: bytes) -> Index:
        index = cls.__new__(cls)
        plain, items = pickle.loads(data)
        vars(index).update(plain, items=[Item(*values) for values in items])
        return index

    def bounds(self, numbers: np.ndarray, step: int) -> np.ndarray:
        """What the items of each block (column) reach at most in each passage of two steps (row)."""
        steps = -(-len(numbers) // step)
        base = len(self.number) + 1
        at, word = np.divmod(np.unique(np.arange(len(numbers)) // step * base + numbers), base)
        at, word = at[word < base - 1], word[word < base - 1]
        start = self.first[word]
        count = self.first[word + 1] - start
        ends = np.cumsum(count)
        flat = np.repeat(start - ends + count, count) + np.arange(count.sum())
        cells = np.repeat(at, count) * self.n_blocks + self.block[flat]
        sums = np.bincount(cells, self.block_max[flat], (steps + 1) * self.n_blocks).reshape(-1, self.n_blocks)
        return sums[:-1] + sums[1:]

    def matches(self, text: str, threshold: float, overlap: float) -> list[tuple[int, float, float, float, int]]:
        """(item id, score, question overlap, answer overlap, first word of the passage) of the
        best passage for each item that is in the text."""
        words = words_of(text)
        if not words or not self.items:
            return []
        none, get, step = len(self.number), self.number.get, self.longest
        numbers = np.fromiter((get(w, none) for w in words), np.int64, len(words))
        # Passages are taken together as long as their bounds stay within some megabytes.
        stride = step * max(1, CELLS // self.n_blocks)
        best: dict[int, tuple] = {}
        for begin in range(0, len(words), stride):
            part = numbers[begin : begin + stride + step]
            passages, blocks = np.nonzero(self.bounds(part, step) >= threshold - 1e-9)
            for p in np.unique(passages).tolist():
                inside = slice(begin + p * step, begin + (p + 2) * step)
                present = np.zeros(none + 1, bool)
                present[numbers[inside]] = True
                for block in blocks[passages == p].tolist():
                    for i in range(block * BLOCK, min(len(self.items), (block + 1) * BLOCK)):
                        number, weight = self.postings[i]
                        score = float(weight[present[number]].sum())
                        if score < threshold - 1e-9:
                            continue
                        item = self.items[i]
                        question, answer = item.overlaps(words[inside])
                        if min(question, answer) >= overlap:
                            row = (item.item_id, score, question, answer, begin + p * step)
                            if i not in best or row[1:4] > best[i][1:4]:
                                best[i] = row
        return [best[i] for i in sorted(best)]


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [words_of(t.as_py()) for t in batch.column(1)]
        lists = pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))
        columns = [*batch.columns, pa.array(map(len, words), pa.int64()), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text", "size", "words"])


def _build(items: int, words: int, longest: int):
    """One index, packed, from the items of one block (item_id, text, df of their words)."""

    def run(table: pa.Table) -> pa.Table:
        texts = list(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True))
        df = {w["word"]: w["df"] for words in table["words"].to_pylist() for w in words}
        index = Index(texts, Benchmark(items, words, longest, df))
        return pa.table({"index": pa.array([index.packed()], pa.binary())})

    return run


def indexes(items: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of all items with words, one after the other; the driver holds one at a time."""
    store = Store(items.sparkSession)
    kind = items.schema[item_col].dataType.simpleString()
    texts = items.select(F.col(item_col).alias("item_id"), text_of(text_col).alias("text"))
    told = texts.mapInArrow(_worded, f"item_id {kind}, text string, size long, words array<string>")
    told = store.save(told.filter("size > 0").withColumn("row", F.monotonically_increasing_id()), "items")
    n = told.agg(F.count("*").alias("items"), F.sum("size").alias("words"), F.max("size").alias("longest")).first()
    if not n.items:
        return
    # Items of like size lie together, in blocks of about ITEMS items and WORDS words.
    blocks = max(-(-n.items // ITEMS), -(-n.words // WORDS))
    if blocks > 1:
        dealt = told.repartitionByRange(blocks, "size", "row").withColumn("block", F.spark_partition_id())
        told = store.save(dealt, "dealt")
    else:
        told = told.withColumn("block", F.lit(0))
    each = told.select("block", "row", F.explode("words").alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    known = each.join(df, "word").groupBy("row").agg(F.collect_list(F.struct("word", "df")).alias("words"))
    full = told.drop("words").join(known, "row").select("block", "item_id", "text", "words")
    built = store.save(full.groupBy("block").applyInArrow(_build(n.items, n.words, n.longest), "index binary"), "indexes")
    for row in built.toLocalIterator():
        yield Index.unpacked(bytes(row["index"]))


def _find(index, threshold: float, overlap: float):
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "start_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        for batch in batches:
            found = [(doc_id, *m) for doc_id, text in rows(batch) for m in own.matches(text, threshold, overlap)]
            types = [batch.schema.field(0).type, *kinds]
            columns = list(zip(*found, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
) -> DataFrame:
    """One row per document and item in it: doc_id, item_id, score (share of the item's BM25
    score in the best passage), question_overlap, answer_overlap, start_word.

    Null and empty texts hold nothing, very long ones are read whole, items without words are in
    nothing, an item given twice is reported twice, a null doc_id is reported as null. Item ids are
    integers. Other columns are not read; empty tables give an empty result. Documents are not
    shuffled: each index is one pass over them.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double, start_word long"
    texts = docs.select(F.col(id_col), text_of(text_col))
    parts = []
    for built in indexes(items, item_col, item_text):
        index = spark.sparkContext.broadcast(built)  # bounded by ITEMS and WORDS
        parts.append(texts.mapInArrow(_find(index, threshold, overlap), schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns. Documents of equal ids leave together."""
    found = contaminated(docs, items, id_col, text_col).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_id"]), "left_anti")
