"""Operator 7: near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its word shingles; its sketch the ``K`` least hashes. Documents of equal sets are
one class, which its least document stands for, so copies never meet in pairs. Inverted lists of the
sketch values find candidates: two sets that are near share at least ``shared`` of ``K`` values (five
standard errors under the mean; exact where both sets are whole in their sketches), so one of the rarest
values of each must be common to both, and only the lists of these are read. With each list entry goes
an odd sketch, ``ODD_BITS`` bits that the values of the set (of the sketch, where the set is large) turn
over: two odd sketches differ in no more bits than what they are made of in values, so pairs that
share too little are seen in the list and go no further. The union sketch estimates the likeness of the
rest; a pair that fails it is no link, and one that passes is verified on the full sets.

First the members of each list meet its most connected one, then another, and each class is verified with
the one it looks most like; so a group of near copies becomes one component without pairs within it.
Then the members of lists that are in different components meet each other, the likeliest first, until
no pair of different components is untried.

Null and empty texts have empty sets and link with nothing. Rows with equal ids and different texts are
documents of their own that share an id: each gets the least id of its component. Rows without an id get
the component of their text, are in none of their own and stay; other columns pass; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.llm.links import components
from quillmask.llm.staging import free_name, stage, table, unstage
from quillmask.llm.words import Words, blocks, mix, runs

K = 64
#: Bits of an odd sketch, in longs of 64, and the largest set whose odd sketch has all values.
ODD_BITS, ODD_WHOLE = 512, 800
ODD = [f"o{i}" for i in range(ODD_BITS // 64)]
#: Rounds in which a list's members meet one of them, and rounds of likeliest pairs before all that are left.
ROUNDS, LIKELIEST = 3, 1
#: Members of one component in a list, from which on they do not meet each other at all.
CROWD = 64
SET = ["n", "d1", "d2"]
SETS = "doc_id long, n long, d1 long, d2 long, sketch array<long>, " + ", ".join(f"{o} long" for o in ODD)


def shared(near: int) -> int:
    """The least number of the union's ``K`` values in both sets, of sets ``near`` hundredths alike."""
    p = near / 100
    return max(1, math.floor(K * p - 5 * math.sqrt(K * p * (1 - p))))


def whole(near: int) -> int:
    """Sets up to this size, and all sets that are near to them, are whole in their sketches."""
    return K * near // 100


def needed(n: Column, near: int) -> Column:
    """The least number of sketch values that a set of this size shares with any near one."""
    return F.when(n <= whole(near), F.ceil(n * near / 100 - 1e-9)).otherwise(F.lit(shared(near)))


def shingle_hashes(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's shingles; A-Z count as a-z."""
    words = Words(texts, lower=True)
    h = words.hashes()
    spans = runs(h, size) if len(h) >= size else np.empty(0, np.uint64)
    out = []
    for first, n in zip(words.doc_first.tolist(), words.count.tolist(), strict=True):
        if n >= size:
            values = np.sort(spans[first : first + n - size + 1])
            out.append(values[np.concatenate(([True], values[1:] != values[:-1]))])
        elif n:
            out.append(mix(runs(h[first : first + n], n) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digests(sets: list[np.ndarray]) -> tuple[list[int], list[int], list[int]]:
    """Size of each set and 128 bits that tell it."""
    d1 = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
    d2 = [int(np.bitwise_xor.reduce(mix(s)).astype(np.int64)) if len(s) else 0 for s in sets]
    return [len(s) for s in sets], d1, d2


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of longs per set: bit b is set if an odd number of its values fall on b."""
    rows = []
    for first in range(0, len(sets), 256):
        some_ = [s if len(s) <= ODD_WHOLE else s[:K] for s in sets[first : first + 256]]
        row = np.repeat(np.arange(len(some_)), [len(s) for s in some_])
        bit = (mix(np.concatenate(some_) ^ np.uint64(0x0DD)) % np.uint64(ODD_BITS)).astype(np.int64)
        odd = np.bincount(row * ODD_BITS + bit, minlength=len(some_) * ODD_BITS) & 1
        rows.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(len(some_), -1))
    return np.concatenate(rows)


def shingle_sets(documents: DataFrame, size: int) -> DataFrame:
    """Size, digest, sketch and odd sketch of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            sets = shingle_hashes(texts, size)
            n, d1, d2 = digests(sets)
            # With the sign bit flipped, signed order is the order of the hashes.
            sketch = [(s[:K] ^ np.uint64(1 << 63)).view(np.int64) for s in sets]
            cut = np.cumsum([0, *map(len, sketch)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(sketch)))
            odd = odd_sketches(sets)
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), lists, *[pa.array(c) for c in odd.T.copy()]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *SET, "sketch", *ODD])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SETS)


def rare_lists(classes: DataFrame, near: int) -> DataFrame:
    """(value, node, pop): of the sketch values of each set that others have, the rarest, as many as it
    must share one of: all but those needed, and one more. ``pop``: how common they all are."""
    values = classes.select("node", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    held = values.join(common, "value").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("held"), F.sum("df").alias("pop"))
    both = held.join(classes.select("node", "n"), "node").withColumn("spare", F.size("held") - needed(F.col("n"), near))
    rarest = F.slice("held", 1, F.col("spare").cast("int") + 1)
    return both.filter("spare >= 0").select("node", "pop", F.explode(rarest).alias("v")).select("v.value", "node", "pop")


def possible(x: str, y: str, near: int) -> Column:
    """Whether sizes and odd sketches of two entries, by their aliases, allow the likeness."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    fits = (nx * 100 >= ny * near) & (ny * 100 >= nx * near)
    differ = sum((F.bit_count(F.col(f"{x}.{o}").bitwiseXOR(F.col(f"{y}.{o}"))) for o in ODD), F.lit(0))
    whole_ = (nx <= ODD_WHOLE) & (ny <= ODD_WHOLE)
    sketched = (nx > ODD_WHOLE) & (ny > ODD_WHOLE)
    # Sets with i values in common have nx + ny - i in all and differ in nx + ny - 2 i.
    few = F.when(whole_, differ * (100 + near) <= (nx + ny) * (100 - near)).when(sketched, differ <= 2 * (K - shared(near))).otherwise(True)
    return fits & few


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]


def led(lists: DataFrame, round_: int, near: int) -> DataFrame:
    """The possible pairs (a, b) of each list's members and its leader: the most connected, then any."""
    order = F.struct("pop", -F.col("node")) if not round_ else F.struct(F.xxhash64(F.lit(round_), "value", "node"), F.lit(0))
    leaders = lists.groupBy("value").agg(F.max_by(F.struct("node", "n", "comp", *ODD), order).alias("l")).select("value", "l.*")
    met = lists.alias("x").join(leaders.alias("y"), (F.col("x.value") == F.col("y.value")) & (F.col("x.comp") != F.col("y.comp")) & possible("x", "y", near))
    return met.select(*ordered("x", "y")).distinct()


def across(lists: DataFrame, near: int) -> DataFrame:
    """The possible pairs (a, b) of members of different components in each list.

    Where a list has a crowd, many members of one component, these do not meet each other. Whoever
    shares a list with a crowd meets all of the component's crowd once, not again in each list.
    """
    crowds = lists.groupBy("value", "comp").agg(F.count("*").alias("m")).filter(F.col("m") >= CROWD).select("value", "comp")
    few = lists.join(crowds, ["value", "comp"], "left_anti")
    many = lists.join(crowds, ["value", "comp"], "left_semi").select("comp", "node", "n", *ODD).dropDuplicates(["node"])
    apart, same = F.col("x.comp") != F.col("y.comp"), F.col("x.value") == F.col("y.value")
    found = few.alias("x").join(few.alias("y"), same & (F.col("x.node") < F.col("y.node")) & apart & possible("x", "y", near)).select(*ordered("x", "y"))

    beside = few.alias("x").join(crowds.alias("y"), same & apart).select("x.node", "x.n", *[f"x.{o}" for o in ODD], F.col("y.comp").alias("other")).dropDuplicates(["node", "other"])
    two = crowds.alias("x").join(crowds.alias("y"), same & (F.col("x.comp") < F.col("y.comp"))).select(F.col("x.comp").alias("comp"), F.col("y.comp").alias("other")).distinct()
    beside = beside.unionByName(many.join(two, "comp").drop("comp"))
    met = beside.alias("x").join(many.alias("y"), (F.col("x.other") == F.col("y.comp")) & possible("x", "y", near)).select(*ordered("x", "y"))
    return found.unionByName(met).distinct()


def estimated(pairs: DataFrame, classes: DataFrame, near: int) -> DataFrame:
    """The pairs (a, b) whose union sketch does not rule them out, with the estimate."""
    left = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    return both.withColumn("u", union).withColumn("shared", F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb"))).withColumn(
        "least", F.when(F.size("u") < K, F.ceil(F.size("u") * near / 100 - 1e-9)).otherwise(F.lit(shared(near)))
    ).filter(F.col("shared") >= F.col("least")).select("a", "b", (F.col("shared") / F.size("u")).alias("guess"))


def full_sets(documents: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(node, n, values): all shingle hashes of the staged classes (node, rep, n, d1, d2), read from their
    texts. Texts stay where they are as long as the classes are few enough to be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in blocks(batches):
            sets = shingle_hashes(raw, size)
            n, d1, d2 = digests(sets)
            cut = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(cut, pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), lists], ["rep", *SET, "values"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    texts = texts.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    found = texts.select("doc_id", "text").mapInArrow(run, "rep long, n long, d1 long, d2 long, values array<long>")
    return found.join(classes, ["rep", *SET]).select("node", "n", "values").dropDuplicates(["node"])


def verified(pairs: DataFrame, documents: DataFrame, classes: DataFrame, size: int, near: int) -> DataFrame:
    """The staged pairs (a, b) whose full sets are at least ``near`` hundredths alike."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stage(classes.select("node", "rep", *SET).join(nodes, "node", "left_semi"), "wanted")
    sets = stage(full_sets(documents, wanted, size), "full")
    left, right = sets.toDF("a", "na", "va"), sets.toDF("b", "nb", "vb")
    common = F.size(F.array_intersect("va", "vb"))
    alike = common * 100 >= (F.col("na") + F.col("nb") - common) * near
    found = stage(pairs.select("a", "b").join(left, "a").join(right, "b").filter(alike).select("a", "b"), "linked")
    unstage(sets, wanted)
    return found


def some(rows: DataFrame) -> bool:
    return bool(rows.limit(1).count())


class Links:
    """The links found so far, their components, and all pairs tried."""

    def __init__(self, documents: DataFrame, classes: DataFrame, size: int, near: int):
        self.documents, self.classes, self.size, self.near = documents, classes, size, near
        self.found: list[DataFrame] = []
        self.tried: list[DataFrame] = []
        self.comps: DataFrame | None = None

    def labelled(self, rows: DataFrame, node: str = "node", comp: str = "comp") -> DataFrame:
        """Adds the component of a column of nodes; a node without links is one of its own."""
        if self.comps is None:
            return rows.withColumn(comp, F.col(node))
        return rows.join(self.comps.toDF(node, comp), node, "left").withColumn(comp, F.coalesce(comp, node))

    def open_lists(self, lists: DataFrame) -> DataFrame:
        """The lists whose members are in more than one component, with ``comp``, sizes and odd sketches."""
        held = self.labelled(lists)
        split = held.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("value")
        held = held.join(split, "value", "left_semi")
        return stage(held.join(self.classes.select("node", "n", *ODD), "node"), "open")

    def fresh(self, pairs: DataFrame) -> DataFrame:
        """The pairs that were not tried and are not in one component."""
        for tried in self.tried:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        return self.labelled(self.labelled(pairs, "a", "ca"), "b", "cb").filter("ca <> cb").drop("ca", "cb")

    def try_(self, pairs: DataFrame) -> None:
        pairs = stage(pairs.select("a", "b"), "pairs")
        if not some(pairs):
            unstage(pairs)
            return
        self.tried.append(pairs)
        links = verified(pairs, self.documents, self.classes, self.size, self.near)
        if not some(links):
            unstage(links)
            return
        self.found.append(links)
        every = self.found[0]
        for more in self.found[1:]:
            every = every.unionByName(more)
        before, self.comps = self.comps, components(every)
        unstage(before)

    def try_likeliest(self, guessed: DataFrame) -> None:
        """Tries the pair of each node that looks most alike, of staged (a, b, guess)."""
        both = guessed.select("a", "b", "guess", F.col("a").alias("own")).unionByName(guessed.select("a", "b", "guess", F.col("b").alias("own")))
        best = both.groupBy("own").agg(F.max(F.struct("guess", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("p"))
        self.try_(best.select((-F.col("p.a")).alias("a"), (-F.col("p.b")).alias("b")).distinct())

    def drop(self) -> None:
        unstage(self.comps, *self.found, *self.tried)


def near_components(documents: DataFrame, size: int, near: int = 80) -> DataFrame:
    """doc_id, n, d1, d2 (size and digest of the set) and comp of every row."""
    sets = stage(shingle_sets(documents, size), "sets")
    classes = sets.filter("n > 0 and doc_id is not null").groupBy(*SET).agg(F.min("doc_id").alias("rep"), F.first(F.struct("sketch", *ODD)).alias("s"))
    # The first classes by id get the least nodes; staged, since the numbers hold for one run only.
    classes = stage(classes.select(F.monotonically_increasing_id().alias("node"), "rep", *SET, "s.*"), "classes")
    slim = stage(sets.select("doc_id", *SET), "sets")
    unstage(sets)
    lists = stage(rare_lists(classes, near), "lists")

    links = Links(documents, classes, size, near)
    for round_ in range(ROUNDS):
        open_ = links.open_lists(lists)
        guessed = stage(estimated(links.fresh(led(open_, round_, near)), classes, near), "guessed")
        links.try_likeliest(guessed)
        unstage(open_, guessed)
    open_ = links.open_lists(lists)
    guessed = stage(estimated(links.fresh(across(open_, near)), classes, near), "guessed")
    unstage(open_, lists)
    for round_ in range(LIKELIEST + 1):
        if not some(guessed):
            break
        if round_ == LIKELIEST:
            links.try_(guessed)
            break
        links.try_likeliest(guessed)
        left = stage(links.fresh(guessed), "guessed")
        unstage(guessed)
        guessed = left

    labels = links.labelled(classes.select("node", "rep", *SET))
    least = labels.groupBy("comp").agg(F.min("rep").alias("least"))
    classed = labels.join(least, "comp").select(*SET, "least")
    result = slim.join(classed, SET, "left")
    result = stage(result.select("doc_id", *SET, F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("comp")), "labels")
    unstage(slim, classes, guessed)
    links.drop()
    return result


def one_of_each(documents: DataFrame, size: int = 5, near: int = 80) -> DataFrame:
    """One document of each component, the least; of repeated rows of an id and a set, all stay.

    Where an id has several texts of which some go, texts are told apart by their sets.
    """
    found = near_components(documents, size, near)
    gone = found.filter("doc_id <> comp")
    kept = found.filter("doc_id = comp").select("doc_id")
    both = stage(gone.select("doc_id").distinct().join(kept, "doc_id", "left_semi"), "both")
    out = documents.join(gone.select("doc_id").distinct().join(both, "doc_id", "left_anti"), "doc_id", "left_anti").select(*documents.columns)
    if not some(both):
        return out

    @F.pandas_udf("n long, d1 long, d2 long")
    def told(texts: pd.Series) -> pd.DataFrame:
        sets = shingle_hashes([(t or "").encode() for t in texts], size)
        return pd.DataFrame(dict(zip(SET, digests(sets), strict=True)))

    mark = free_name(documents.columns, "set")
    again = out.join(both, "doc_id", "left_semi").withColumn(mark, told("text"))
    less = gone.select("doc_id", F.struct(*SET).alias(mark)).distinct()
    again = again.join(less, ["doc_id", mark], "left_anti").select(*documents.columns)
    return out.join(both, "doc_id", "left_anti").select(*documents.columns).unionByName(again)


def op7_near_duplicates(spark, sf_dir) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 2)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), (F.col("doc_id") == F.col("comp")).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2)
      UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1),
s AS (SELECT w.doc_id, count(t.t) AS n FROM w LEFT JOIN t ON w.doc_id = t.doc_id GROUP BY w.doc_id),
x AS (SELECT t.doc_id, n, t FROM t JOIN s ON t.doc_id = s.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m ON s.doc_id = m.doc_id
"""
