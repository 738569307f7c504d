"""Ranked lexical search of all documents for a set of items, by dual trees.

Documents are reduced once to the terms that some item holds.  Items and, batch by batch,
documents are put into binary hierarchies of rows with shared terms; every node holds the
maximum of each coordinate below it (an item's weight of a term, a document's impact of a
term).  The product of two nodes' maxima bounds the score of every pair below them, so a
pair of nodes is left out with all its documents once the bound is under the weakest k-th
score of the node's items.  Scores of the leaf pairs that remain are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, about, blobs, table

#: Items and bytes of item text that one pass over the documents answers.
ITEMS, ITEM_BYTES = 8_192, 4 << 20
#: Rows of a leaf of the items' and of the documents' hierarchy.
ITEM_LEAF, DOC_LEAF = 8, 64
#: Random directions in which rows are compared when a hierarchy is built.
SKETCH = 16
#: Documents whose scores give the first k-th scores; they only spare work.
SEED = 4_096
#: Bounds are widened by this share, for the rounding of doubles.
SLACK = 1e-9

#: Bytes of terms, A-Z folded; other ASCII bytes part terms.
_PARTS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and digits and of any character beyond ASCII."""
    return raw.translate(_PARTS).split()


@dataclass
class Node:
    rows: np.ndarray
    terms: np.ndarray  # ascending
    most: np.ndarray  # the maximum of each of them below
    below: list["Node"] = field(default_factory=list)


@dataclass
class Sparse:
    """Rows of (term, value); ``edge`` has the place of each row's first entry and of the end."""

    edge: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the places of the rows' entries, their row's position)."""
        size = self.edge[rows + 1] - self.edge[rows]
        at = np.repeat(self.edge[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return at, np.repeat(np.arange(len(rows)), size)


def hierarchy(data: Sparse, rows: np.ndarray, leaf: int, scale: np.ndarray) -> Node:
    """A binary tree of rows: each node is halved along the main direction of its rows' sketches.

    ``scale`` weighs the terms.  A sketch is the row, of length 1, in SKETCH random directions.
    """
    at, line = data.places(rows)
    value = data.values[at] * scale[data.terms[at]]
    ways = np.random.default_rng(5).standard_normal((len(scale), SKETCH)).astype(np.float32)
    sketch = np.column_stack([np.bincount(line, value * ways[data.terms[at], d], len(rows)) for d in range(SKETCH)])
    sketch /= np.maximum(np.sqrt(np.bincount(line, value**2.0, len(rows))), 1e-300)[:, None]
    spot = np.zeros(len(data.edge), np.int64)
    spot[rows] = np.arange(len(rows))

    def grow(rows: np.ndarray) -> Node:
        if len(rows) <= leaf:
            at, _ = data.places(rows)
            order = np.argsort(data.terms[at], kind="stable")
            t, v = data.terms[at][order], data.values[at][order]
            start = np.flatnonzero(np.diff(t, prepend=-1))
            return Node(rows, t[start], np.maximum.reduceat(v, start) if len(start) else v)
        x = sketch[spot[rows]]
        x = x - x.mean(0)
        way = x[(x * x).sum(1).argmax()]
        for _ in range(4):
            way = x.T @ (x @ way)
            way /= max(np.sqrt(way @ way), 1e-300)
        order = np.argsort(x @ way, kind="stable")
        half = len(rows) // 2
        below = [grow(rows[np.sort(order[:half])]), grow(rows[np.sort(order[half:])])]
        t = np.union1d(below[0].terms, below[1].terms)
        most = np.zeros(len(t), np.int64)
        for x in below:
            at = np.searchsorted(t, x.terms)
            most[at] = np.maximum(most[at], x.most)
        return Node(rows, t, most, below)

    return grow(rows)


class Best:
    """The k best documents of each item: scores, places, and the least score that still enters."""

    def __init__(self, items: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, np.maximum(floor, 1)
        self.least = self.floor.copy()
        self.score = [np.zeros(0, np.int64)] * items
        self.place = [np.zeros(0, np.int64)] * items

    def offer(self, item: int, score: np.ndarray, place: np.ndarray) -> None:
        s, p = np.append(self.score[item], score), np.append(self.place[item], place)
        keep = np.lexsort((p, -s))[: self.k]
        self.score[item], self.place[item] = s[keep], p[keep]
        if len(keep) == self.k:
            self.least[item] = max(self.least[item], s[keep[-1]])


def search(documents: Sparse, items: Sparse, tree: Node, width: int, best: Best) -> int:
    """Offer every document that can be among an item's k best; gives the number of pairs that were scored.

    A document's place is its row, so rows must be in the order in which ties are broken.
    """
    filled = np.flatnonzero(np.diff(documents.edge) > 0)
    if not len(filled) or not len(tree.rows):
        return 0
    scale = np.zeros(width)
    scale[tree.terms] = tree.most
    most, where, scored = np.zeros(width), np.full(width, -1, np.int64), 0
    # sums of weight times impact are exact in doubles below 2^53
    heaviest = max(float(np.add.reduceat(items.values, items.edge[:-1][np.diff(items.edge) > 0]).max(initial=0)), 1.0)
    number = np.float64 if heaviest * float(documents.values.max(initial=0)) < 1 << 53 else np.int64
    weights: dict[int, np.ndarray] = {}

    def weight(node: Node) -> np.ndarray:
        """(terms, items) of a leaf of the items."""
        if id(node) not in weights:
            at, line = items.places(node.rows)
            out = np.zeros((len(node.terms), len(node.rows)), number)
            out[np.searchsorted(node.terms, items.terms[at]), line] = items.values[at]
            weights[id(node)] = out
        return weights[id(node)]

    todo = [(hierarchy(documents, filled, DOC_LEAF, scale), [tree])]
    while todo:
        docs, open_ = todo.pop()
        most[docs.terms] = docs.most
        kept = []
        while open_:
            node = open_.pop()
            bound = float(most[node.terms] @ node.most) * (1 + SLACK)
            if bound >= best.least[node.rows].min():
                if docs.below or not node.below:
                    kept.append((bound, node))
                else:
                    open_ += node.below
        most[docs.terms] = 0
        if docs.below:
            next_ = [x for _, node in kept for x in (node.below or [node])]
            if next_:
                # the half that promises more is searched first, which raises the k-th scores
                promise = [self_bound(half, next_, most) for half in docs.below]
                for at in np.argsort(promise):
                    todo.append((docs.below[at], list(next_)))
            continue
        at, line = documents.places(docs.rows)
        for bound, node in sorted(kept, key=lambda x: -x[0]):
            if bound < best.least[node.rows].min():
                continue
            where[node.terms] = np.arange(len(node.terms))
            spot = where[documents.terms[at]]
            where[node.terms] = -1
            held = np.zeros((len(docs.rows), len(node.terms)), number)
            held[line[spot >= 0], spot[spot >= 0]] = documents.values[at][spot >= 0]
            score = (held @ weight(node)).astype(np.int64)
            scored += score.size
            enters = score >= best.least[node.rows]
            for i in np.flatnonzero(enters.any(0)):
                best.offer(node.rows[i], score[enters[:, i], i], docs.rows[enters[:, i]])
    return scored


def self_bound(docs: Node, nodes: list[Node], most: np.ndarray) -> float:
    """The largest bound of a document node with any of some item nodes."""
    most[docs.terms] = docs.most
    out = max(float(most[x.terms] @ x.most) for x in nodes)
    most[docs.terms] = 0
    return out


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0, all if fewer.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, only A-Z
    lower-cased.  With N documents that have a term, L terms of all documents, n terms of
    one and df documents that hold a term, a term weighs floor(1000 ln((2N+2) / (2df+1)));
    a document's m is 75 + 25nN div L; its score sums, over the item's terms with repeats,
    weight * (10^9 tf div (1000 tf + 12 m)).

    Every document row is a document, repeated or not; equal scores go by ascending id,
    null last.  Null and empty texts hold no term.  Rows of items with a null id take no
    part; repeated item rows count once, and of an id's several texts the least.  Ids may
    have any type that can be ordered.  An empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "lexical")
    asked = items.where(F.col(item_col).isNotNull()).groupBy(F.col(item_col).alias("item_id")).agg(F.min(item_text_col).alias("text")).where(F.length("text") > 0)
    told = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_type, id_type = dict(asked.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    if not told["n"]:
        return out
    blocks = max(-(-told["n"] // ITEMS), -(-told["bytes"] // ITEM_BYTES))
    asked = scratch.table(asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")))
    for b in range(blocks):
        found = _ranked(docs, asked.where(F.col("block") == b), k, scratch, id_type)
        if found is not None:
            out = found if b == 0 else out.unionByName(found)
    return out


def _ranked(docs: DataFrame, asked: DataFrame, k: int, scratch: Scratch, id_type: str) -> DataFrame | None:
    """The ranking for one block of items."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    block = asked.orderBy("item_id").toArrow()  # about ITEMS rows and ITEM_BYTES of text, by the hash that deals the blocks
    counted = [Counter(terms(t.encode())) for t in block["text"].to_pylist()]
    names = sorted({t for c in counted for t in c})
    if not names:
        return None
    width = len(names)
    vocabulary = spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})  # of one block

    def reduce(batches):
        known = vocabulary.value
        for batch in batches:
            raw, edge = blobs(batch.column(1))
            size, count, at, tf = np.zeros(len(batch), np.int64), np.zeros(len(batch) + 1, np.int32), [], []
            for i in range(len(batch)):
                own = terms(raw[edge[i] : edge[i + 1]].tobytes())
                held = Counter(map(known.get, own))
                held.pop(None, None)
                size[i], count[i + 1] = len(own), len(held)
                at += held.keys()
                tf += held.values()
            edges = pa.array(np.cumsum(count, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *lists], ["doc_id", "n", "terms", "tf"])

    reduced = scratch.table(docs.mapInArrow(reduce, f"doc_id {id_type}, n long, terms array<int>, tf array<int>"))
    total = reduced.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.sum("n").alias("L")).first()
    if not total["L"]:
        return None

    def count(batches):
        out = np.zeros(width, np.int64)
        for batch in batches:
            out += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        held = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(out[held])], ["term", "df"])

    df = np.zeros(width, np.int64)
    for r in reduced.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a block's terms
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * total["N"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    row = [np.array([vocabulary.value[t] for t in c], np.int64) for c in counted]
    matrix = Sparse(
        np.append(0, np.cumsum([len(x) for x in row])).astype(np.int64), np.concatenate(row),
        np.concatenate([weight[x] * np.array(list(c.values()), np.int64) for x, c in zip(row, counted)]),
    )
    tree = hierarchy(matrix, np.flatnonzero(np.diff(matrix.edge) > 0), ITEM_LEAF, np.ones(width))
    many = len(counted)

    def over(floor: np.ndarray):
        shared = spark.sparkContext.broadcast((matrix, tree, floor))  # of one block

        def run(batches):
            items, tree, floor = shared.value
            kind = None
            for batch in batches:
                # rows by id, so that a smaller place breaks ties
                batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_end"))
                edge = np.append(0, np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))).astype(np.int64)
                term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                n = batch.column(1).to_numpy()
                if 25 * int(n.max(initial=0)) * total["N"] >= 1 << 63:
                    n = n.astype(object)
                m = (75 + 25 * n * total["N"] // total["L"]).astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(edge)))
                best = Best(many, k, floor)
                search(Sparse(edge, term, impact), items, tree, width, best)
                item = np.repeat(np.arange(many, dtype=np.int32), [len(x) for x in best.score])
                own = pa.table({"item": item, "doc_id": batch.column(0).take(pa.array(np.concatenate(best.place))), "score": np.concatenate(best.score)})
                kind = own if kind is None else pa.concat_tables([kind, own])
                kind = kind.sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
                line = kind["item"].to_numpy()
                start = np.flatnonzero(np.diff(line, prepend=-1))
                size = np.diff(np.append(start, len(line)))
                kind = kind.filter(pa.array(np.arange(len(line)) - np.repeat(start, size) < k)).combine_chunks()
                full = size >= k
                last = kind["score"].to_numpy()[np.cumsum(np.minimum(size, k))[full] - 1] if full.any() else np.zeros(0, np.int64)
                floor = floor.copy()
                floor[line[start[full]]] = np.maximum(floor[line[start[full]]], last)
            if kind is not None:
                yield from kind.to_batches()

        return run

    schema = f"item int, doc_id {id_type}, score long"
    seeds = reduced.where((F.size("terms") > 0) & about(SEED // 2, total["N"], F.col("doc_id"), F.col("n")))
    by = Window.partitionBy("item").orderBy(F.desc("score"))
    floor = np.zeros(many, np.int64)
    first = seeds.mapInArrow(over(floor), schema).withColumn("at", F.row_number().over(by)).where(F.col("at") == k)
    for r in first.collect():  # at most one row an item of the block
        floor[r["item"]] = r["score"]
    found = reduced.where(F.size("terms") > 0).mapInArrow(over(floor), schema)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    name = spark.createDataFrame(pa.table({"item": np.arange(many, dtype=np.int32), "item_id": block["item_id"]}))
    return found.join(F.broadcast(name), "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS t FROM documents),
n AS MATERIALIZED (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
a AS (SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM n),
m AS (SELECT r, doc_id, 75 + (25 * n.n * a.N) // a.L AS m FROM n, a),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark) GROUP BY ALL),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), a),
s AS (SELECT item_id, r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s JOIN m USING (r) WHERE score > 0 QUALIFY rank <= 20
"""
