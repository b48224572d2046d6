"""Exact Jaccard join of documents on word n-grams, with adaptive multi-match prefixes.

Documents of equal n-gram sets form one class and go on as one. Two sets of similarity t or
more share at least l tokens among the first |s| - ceil(t|s|) + l of each, in any one order of
all tokens. A first sieve in hash order leaves the documents that share enough at all. For
those, tokens are ordered from rare to frequent, and every document takes the l that makes its
expected lists and candidates cheapest: a longer prefix, but more shared tokens before a pair
is verified.

Only components are asked for, so pairs within one component need no look. Lists are first
compared with their most central document, which joins a group of near copies in linear time;
then all pairs that share enough and still lie in different components are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import Memo, Store, longs, rows, slices, text_of
from vulnspark.llm.sieve import rolling
from vulnspark.operators.arrow import list_array

N = 5
#: Similarity in hundredths.
PERCENT = 75
#: Of so many tokens the sieve asks for one more shared one.
SIEVE = 20
#: The cost of verifying a candidate, in list entries; prefixes are lengthened by up to `LONGEST`.
VERIFY = 20.0
LONGEST = 16
LEADER_ROUNDS = 2


class Shingles:
    """The distinct shingles of a text as sorted hashes (uint64)."""

    def __init__(self, n: int):
        self.n, self.hash = n, Memo(xxhash.xxh64_intdigest, 400_000)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # of bytes: ASCII letters and white space only
        units = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        if len(words) < self.n:
            whole = xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))
            return np.array([whole] if words else [], np.uint64)
        return np.unique(rolling(units, self.n))


def own_share(n, percent: int = PERCENT):
    """The least number of shared tokens of a set of n with any similar one: ceil(t * n)."""
    return (n * percent + 99) // 100


def _sets(n: int, take):
    """Size and digest of each document's set, and its first take(n) tokens in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in slices(batches):
            sizes, digests, first = [], [], [np.empty(0, np.uint64)]
            for _, text in rows(batch):
                own = shingles(text)
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                first.append(own[: take(len(own))])
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            lists = list_array(np.array([len(f) for f in first[1:]], np.int64), longs(np.concatenate(first)))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "s1", "s2", "first"])

    return run


def _tokens(n: int):
    """(doc_id, token) of every token of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in slices(batches):
            found, sizes = [np.empty(0, np.uint64)], []
            for _, text in rows(batch):
                own = shingles(text)
                found.append(own)
                sizes.append(len(own))
            at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), longs(np.concatenate(found))], names=["doc_id", "token"])

    return run


def best_length(frequencies: np.ndarray, spare: int) -> int:
    """l of least cost: `spare` + l tokens (rare ones first) give that many list entries, of which
    at most one in l is a candidate."""
    reach = np.arange(1, min(LONGEST, max(1, len(frequencies) - spare)) + 1)
    entries = np.cumsum(frequencies - 1)[np.minimum(spare + reach, len(frequencies)) - 1]
    return int(reach[np.argmin(entries + VERIFY * entries / reach)])


def largest_partner(n: int, shared: int, percent: int) -> int:
    """The size of the largest set that one of n tokens, `shared` of them in other sets too, can be
    similar to: they share percent / (100 + percent) of both sizes."""
    return min(shared * (100 + percent) // percent - n, n * 100 // percent)


def _prefixes(percent: int):
    """Documents that can still have a partner, with their shared tokens and the prefix of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "most", "tokens", "taken", "need", "alone"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, n, shared in rows(batch):
                alone = n - len(shared)
                spare = n - own_share(n, percent) - alone
                most = largest_partner(n, len(shared), percent)
                if spare < 0 or most < own_share(n, percent):
                    continue
                # Lists are dearest among sets of one size, so the length is chosen for those.
                alike = max(0, n - -(-2 * percent * n // (100 + percent)) - alone)
                need = best_length(np.array([x["f"] for x in shared], np.int64), alike)
                values = (doc_id, n, most, [x["token"] for x in shared], min(spare + need, len(shared)), need, alone / n)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, root): the nodes of `edges` (a, b), each with one root of its component.

    Every node hooks on its neighbour of least hashed rank, chains are shortened, and the edges
    between roots go into the next round; hashed ranks keep chains and rounds logarithmic. The
    tables of a round are no larger than its edges."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
    edges = store.save(edges.select("a", "b").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        hooked = hooked.select(F.col("a").alias("node"), F.least(rank("a"), F.col("least"))["x"].alias("to"))
        for _ in range(2):
            hooked = store.save(hooked, "hooked")
            up = hooked.select(F.col("node").alias("to"), F.col("to").alias("top"))
            hooked = hooked.join(up, "to", "left").select("node", F.coalesce("top", "to").alias("to"))
        hooked = store.save(hooked, "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("to").alias("top"))
        if roots is None:
            roots = up.select(F.col("root").alias("node"), F.col("top").alias("root"))
        else:
            roots = roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = store.save(roots, "roots")
        ends = edges.join(hooked.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        ends = ends.join(hooked.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        edges = store.save(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def size_class(n):
    """Numbers of sizes in steps of a twentieth."""
    return F.floor(F.log(n) / F.log(F.lit(1.05)))


class _Join:
    """Finds the links between prefixes that connect components, and the components."""

    def __init__(self, prefixes: DataFrame, store: Store, percent: int):
        self.store, self.percent, self.docs = store, percent, prefixes
        token = F.posexplode(F.slice("tokens", F.lit(1), F.col("taken"))).alias("at", "token")
        lists = prefixes.select("doc_id", "n", "most", "need", "alone", F.size("tokens").alias("shared"), token)
        # A token at this place is in the prefix only for partners so small that what comes after
        # it is enough to share.
        after = F.col("shared") - F.col("at") - 1 + F.col("need")
        most = F.least("most", F.floor(after * (100 + percent) / percent).cast("long") - F.col("n"))
        lists = lists.withColumn("most", most).filter(F.col("most") * 100 >= F.col("n") * percent)
        self.lists = store.save(lists.drop("at", "shared"), "lists")
        self.edges = prefixes.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
        self.roots = components(self.edges, store)

    def mixed(self) -> DataFrame:
        """Entries of the lists that hold more than one component, with the list's leader."""
        roots = self.roots.withColumnRenamed("node", "doc_id")
        own = self.lists.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        own = self.store.save(own, "entries")
        first = F.min(F.struct("alone", "doc_id", "root", "n", "most")).alias("first")
        stats = own.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), first)
        stats = stats.filter("low <> high").select("token", "first")
        found = self.store.save(own.join(self.store.save(stats, "stats"), "token"), "mixed")
        self.store.drop(own)
        return found

    def fits(self, n_a, most_a, n_b, most_b):
        """Whether sizes alone allow the two to be similar."""
        return (n_a <= most_b) & (n_b <= most_a)

    def verify(self, pairs: DataFrame) -> None:
        """Adds the pairs (a, b) that are similar to the edges. The sets of b travel with the pairs,
        those of a are joined where they arrive."""
        sets = self.docs.select("doc_id", "n", "tokens")
        one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
        two = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
        shared = F.size(F.array_intersect("t_a", "t_b"))
        told = self.store.save(pairs, "pairs").join(two, "b").join(one, "a").withColumn("shared", shared)
        links = told.filter(F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * self.percent)
        self.edges = self.store.save(self.edges.unionByName(links.select("a", "b")), "links")
        self.roots = components(self.edges, self.store)

    def by_leaders(self) -> None:
        mixed, first = self.mixed(), F.col("first")
        able = self.fits(F.col("n"), F.col("most"), first["n"], first["most"]) & (F.col("root") != first["root"])
        pairs = mixed.filter(able).select(first["doc_id"].alias("a"), F.col("doc_id").alias("b"))
        self.verify(pairs.distinct())
        self.store.drop(mixed)

    def by_counts(self) -> None:
        """All pairs of different components that share as many prefix tokens as either asks for.

        Of two similar sets the smaller could have a partner of its own size, so lists are kept by
        size class and hold only entries that allow one; those look for larger partners, the
        others for smaller ones. Entries of a list's largest component meet only those of
        others."""
        mixed = self.mixed()
        sizes = mixed.groupBy("token", "root").count()
        main = self.store.save(sizes.groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("main")), "main")
        entries = mixed.join(main, "token").withColumn("in_main", F.col("root") == F.col("main"))
        entries = self.store.save(entries.select("token", "doc_id", "n", "most", "need", "root", "in_main"), "told")
        self.store.drop(mixed)
        equal = F.col("most") >= F.col("n")
        named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "n", "most", "need", "root", "in_main")]
        low = F.when(equal, F.col("n")).otherwise(F.ceil(F.col("n") * self.percent / 100))
        classes = F.sequence(size_class(low), size_class(F.col("most")))
        x = entries.select("token", *named("x"), low.alias("low_x"), F.explode(classes).alias("size"))
        y = entries.filter(equal).select("token", *named("y"), size_class(F.col("n")).alias("size"))
        able = self.fits(F.col("n_x"), F.col("most_x"), F.col("n_y"), F.col("most_y")) & (F.col("root_x") != F.col("root_y"))
        once = (F.col("n_y") >= F.col("low_x")) & ((F.col("n_x") != F.col("n_y")) | (F.col("doc_id_x") < F.col("doc_id_y")))
        keys = ["token", "size"]
        met = x.filter("NOT in_main_x").join(y, keys).filter(able & once)
        met = met.unionByName(x.filter("in_main_x").join(y.filter("NOT in_main_y"), keys).filter(able & once))
        need = F.min(F.least("need_x", "need_y")).alias("need")
        # Which of the two looks for the other changes from token to token: a pair's tokens count together.
        ends = [F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")]
        pairs = met.groupBy(*ends).agg(F.count("*").alias("met"), need)
        self.verify(pairs.filter("met >= need").select("a", "b"))


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links
    of at least percent/100 Jaccard similarity, itself included).

    Null and empty texts, and those of white space only, have no shingles and are linked with
    nothing: their component is their own id. Equal sets are linked. Rows of a null id do not
    link; a null id's component is null. Rows repeating an id share its component. Other columns
    are not read; an empty table gives no rows.
    """
    store = Store(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    prefix = lambda size: size - own_share(size, percent) + 1 + size // SIEVE if size else 0
    shape = f"doc_id {kind}, n long, s1 long, s2 long, first array<long>"
    sets = store.save(texts.mapInArrow(_sets(n, prefix), shape), "sets")
    known = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = store.save(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    chosen = classes.select(F.col("rep").alias("doc_id")).distinct()

    schema = f"doc_id {kind}, token long"
    firsts = sets.select("doc_id", "first").join(chosen, "doc_id")
    first = store.save(firsts.select("doc_id", F.explode("first").alias("token")), "prefixes")
    often = store.save(first.groupBy("token").agg(F.count("*").alias("f")).filter("f > 1").select("token"), "often")
    met = store.save(first.join(often, "token").groupBy("doc_id").agg(F.count("*").alias("met")), "met")
    store.drop(first, often)
    # A partner may be smaller and so have emitted a shorter prefix: its share is what is asked for.
    least = F.lit(1) + F.floor(F.ceil(F.col("n") * percent / 100) / SIEVE)
    sizes = known.groupBy("doc_id").agg(F.max("n").alias("n"))
    left = store.save(met.join(sizes, "doc_id").filter(F.col("met") >= least).select("doc_id", "n"), "sieved")

    tokens = store.save(texts.join(left.select("doc_id"), "doc_id").mapInArrow(_tokens(n), schema), "tokens")
    tally = store.save(tokens.groupBy("token").agg(F.count("*").cast("int").alias("f")).filter("f > 1"), "tally")
    listed = F.sort_array(F.collect_list(F.struct("f", "token"))).alias("shared")
    shared = tokens.join(tally, "token").groupBy("doc_id").agg(listed).join(left, "doc_id").select("doc_id", "n", "shared")
    kept = f"doc_id {kind}, n long, most long, tokens array<long>, taken int, need int, alone double"
    prefixes = store.save(shared.mapInArrow(_prefixes(percent), kept), "able")
    store.drop(tokens, tally)

    join = _Join(prefixes, store, percent)
    for _ in range(LEADER_ROUNDS):
        join.by_leaders()
    join.by_counts()
    least_of = join.roots.groupBy("root").agg(F.min("node").alias("component"))
    linked = store.save(join.roots.join(least_of, "root").select(F.col("node").alias("rep"), "component"), "linked")
    named = store.save(classes.join(linked, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component")), "named")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return sets.join(named, ["s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_first_of_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of the smallest id of their component, with all their columns; those of a null
    id stay."""
    found = similar_components(docs, id_col, text_col)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["_id"], "left_anti")
