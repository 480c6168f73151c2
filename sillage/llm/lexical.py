"""Ranked lexical search for many queries at once by common-subexpression evaluation (operator 11).

Items that ask for the same terms share the work. Their term sets are mined for pairs of terms that several items
hold; a pair becomes a node that stands for both and can be paired again, so that a set shared by many items ends
as one node of a graph. For a chunk of documents every term's accumulator (its part of each document's score) is
made once, every node adds its two parts once, and an item adds the few nodes it is left with. All numbers are
64-bit integers, so the order of the sums does not matter.

Documents are read twice: once to count terms (the postings of the asked terms are staged), once to score. Items are
dealt to blocks of ``BLOCK_TERMS`` terms and mined in a task per block; each block has a pass over the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillage.llm.dealing import blocked
from sillage.llm.text import ALNUM, blocks, word_hashes
from sillage.session import stage

K = 10
#: terms of all items of a block, so many that a block's graph takes some megabytes; more items take more passes
BLOCK_TERMS = 250_000
#: numbers of accumulators held at once
_CELLS = 1 << 22
_MOST_DOCS = 1024
_GRAPH = "_block long, rows array<long>, terms array<long>, left array<int>, right array<int>, tops array<int>, sizes array<int>"


@dataclass
class Graph:
    """Nodes 0.. are terms (sorted hashes), further ones the sum of two earlier nodes; each item is a sum of ``tops``."""

    rows: np.ndarray
    terms: np.ndarray
    left: np.ndarray
    right: np.ndarray
    tops: np.ndarray
    sizes: np.ndarray

    @property
    def nodes(self) -> int:
        return len(self.terms) + len(self.left)

    def levels(self) -> list[np.ndarray]:
        """The sums in steps that need only earlier steps, as indices into ``left``."""
        n, depth = len(self.terms), np.zeros(self.nodes, np.int64)
        for j, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            depth[n + j] = max(depth[a], depth[b]) + 1
        made = depth[n:]
        order = np.argsort(made, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(made[order])) + 1) if len(order) else []


def mine(rows: np.ndarray, terms_of: list[np.ndarray]) -> Graph:
    """The graph of sets of terms, one of at least one term for each of ``rows``.

    In each round items sort their nodes by how many items hold them, and neighbours that stand together in two
    items or more, the most frequent first, become a node; a node is paired once in a round. It ends when no
    neighbours meet twice.
    """
    sizes = np.array([len(t) for t in terms_of], np.int64)
    terms, symbols = np.unique(np.concatenate(terms_of) if terms_of else np.zeros(0, np.uint64), return_inverse=True)
    item = np.repeat(np.arange(len(sizes)), sizes)
    left, right, nodes = [], [], len(terms)
    while len(symbols) > 1:
        order = np.lexsort((symbols, -np.bincount(symbols, minlength=nodes)[symbols], item))
        item, symbols = item[order], symbols[order]
        at = np.flatnonzero(item[1:] == item[:-1])
        codes, many = np.unique(symbols[at] * np.int64(nodes) + symbols[at + 1], return_counts=True)
        often = np.flatnonzero(many > 1)
        often = often[np.argsort(-many[often], kind="stable")]
        taken, chosen = np.zeros(nodes, bool), {}
        for code in codes[often].tolist():
            a, b = divmod(code, nodes)
            if not (taken[a] or taken[b]):
                taken[a] = taken[b] = True
                chosen[code] = nodes + len(chosen)
                left.append(a)
                right.append(b)
        if not chosen:
            break
        known = np.array(sorted(chosen), np.int64)
        made = np.array([chosen[c] for c in known.tolist()])
        here = symbols[at] * np.int64(nodes) + symbols[at + 1]
        place = np.minimum(np.searchsorted(known, here), len(known) - 1)
        hit = known[place] == here
        symbols[at[hit]] = made[place[hit]]
        stay = np.ones(len(symbols), bool)
        stay[at[hit] + 1] = False
        item, symbols, nodes = item[stay], symbols[stay], nodes + len(chosen)
    return Graph(rows, terms, np.array(left, np.int64), np.array(right, np.int64), symbols, np.bincount(item, minlength=len(sizes)))


def _mine_task(table: pa.Table) -> pa.Table:
    of = table.column("_terms").combine_chunks()
    at, terms = of.offsets.to_numpy(), of.values.to_numpy(zero_copy_only=False).view(np.uint64)
    graph = mine(table.column("_row").to_numpy(), [terms[a:b] for a, b in zip(at[:-1], at[1:])])
    arrays = [graph.rows, graph.terms.view(np.int64), *(x.astype(np.int32) for x in (graph.left, graph.right, graph.tops, graph.sizes))]
    return pa.table({"_block": table.column("_block")[:1], **{n: pa.array([x]) for n, x in zip(("rows", "terms", "left", "right", "tops", "sizes"), arrays)}})


def _terms_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct hashes of every text's terms."""
    for batch in batches:
        for block in blocks(batch.column(1)):
            words, firsts = word_hashes(block, ALNUM)
            found = [np.unique(words[a:b]).view(np.int64) for a, b in zip(firsts[:-1], firsts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows[0], block.size), pa.array(found, pa.list_(pa.int64()))], ["_item", "_terms"])


def _postings_task(terms: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For every text its number of terms, and which of the sorted ``terms`` it holds how often."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                words, firsts = word_hashes(block, ALNUM)
                place = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
                hit = np.flatnonzero(terms[place] == words)
                owner = np.searchsorted(firsts, hit, "right") - 1
                codes, many = np.unique(owner * np.int64(len(terms)) + place[hit], return_counts=True)
                at = pa.array(np.searchsorted(codes, np.arange(block.size + 1) * np.int64(len(terms))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.rows[0], block.size), pa.array(np.diff(firsts)),
                     pa.ListArray.from_arrays(at, pa.array((codes % len(terms)).astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(many))],
                    ["_id", "_n", "_t", "_tf"],
                )

    return task


def _best(item: np.ndarray, score: np.ndarray, missing: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k highest scores of each item; equal scores by ascending id, rows without id last."""
    order = np.lexsort((ids, missing, -score, item))
    item = item[order]
    keep = np.arange(len(item)) - np.searchsorted(item, item) < k
    order = order[keep]
    return item[keep], score[order], missing[order], ids[order]


def _score_task(graph: Graph, weights: np.ndarray, documents: int, length: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best documents of every item among those of a task."""
    steps, firsts = graph.levels(), np.cumsum(graph.sizes) - graph.sizes
    most = int(min(_MOST_DOCS, max(8, _CELLS // (graph.nodes + len(graph.tops)))))

    def scores(n: np.ndarray, owner: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 100 - 90 + (90 * n * documents) // length
        accumulators = np.zeros((graph.nodes, len(n)), np.int64)
        accumulators[terms, owner] = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        for step in steps:
            accumulators[len(graph.terms) + step] = accumulators[graph.left[step]] + accumulators[graph.right[step]]
        return np.add.reduceat(accumulators[graph.tops], firsts, axis=0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = tuple(np.zeros(0, np.int64) for _ in range(4))
        for batch in batches:
            ids, n = batch.column(0), batch.column(1).to_numpy()
            missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.cast(pa.int64()).fill_null(0).to_numpy()
            at, terms = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            tf = batch.column(3).values.to_numpy()
            for a in range(0, len(n), most):
                b = min(a + most, len(n))
                owner = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
                found = scores(n[a:b], owner, terms[at[a] : at[b]], tf[at[a] : at[b]])
                least, full = np.ones(len(firsts), np.int64), np.bincount(best[0], minlength=len(firsts)) >= k
                if full.any():
                    lowest = np.flatnonzero(np.append(best[0][1:] != best[0][:-1], True))
                    least[full] = best[1][lowest][full[best[0][lowest]]]
                item, doc = np.nonzero(found >= least[:, None])
                best = _best(*(np.concatenate(x) for x in zip(best, (item, found[item, doc], missing[a + doc], ids[a + doc]))), k)
        item, score, missing, ids = best
        yield pa.RecordBatch.from_arrays(
            [pa.array(graph.rows[item]), pa.array(ids, mask=missing.astype(bool)), pa.array(score)], ["_row", "_id", "_score"]
        )

    return task


def graphs(items: DataFrame, item_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, Iterator[Graph]]:
    """The items that have terms, with a number of their own (``_item``, ``_row``), and the graph of each block of them."""
    kind = items.schema[item_col].dataType.simpleString()
    terms = items.select(item_col, text_col).mapInArrow(_terms_task, f"_item {kind}, _terms array<long>")
    sets = terms.select("_item", F.explode("_terms").alias("t")).groupBy("_item").agg(F.collect_set("t").alias("_terms"))
    dealt = stage(blocked(sets, F.size("_terms"), block_terms, "terms"), "items")
    mined = stage(dealt.groupBy("_block").applyInArrow(_mine_task, _GRAPH), "graphs")
    numbers = sorted(r[0] for r in mined.select("_block").collect())

    def each() -> Iterator[Graph]:
        for number in numbers:
            row = mined.where(F.col("_block") == number).toArrow()
            rows, terms, left, right, tops, sizes = (row.column(c)[0].values.to_numpy() for c in ("rows", "terms", "left", "right", "tops", "sizes"))
            yield Graph(rows, terms.view(np.uint64), left.astype(np.int64), right.astype(np.int64), tops.astype(np.int64), sizes.astype(np.int64))

    return dealt.select("_item", "_row"), each()


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The k highest-scoring rows of ``docs`` for each item: the item's id, rank from 1, the row's id (integer), score above 0.

    Terms are runs of ASCII letters and digits and of all that is outside ASCII, lower-cased in ASCII. Rows of one
    item id are one item, rows without item id too; an item without terms, or whose terms no row holds, has no rank.
    Null and empty texts have no terms and do not count. Repeated rows count and rank each for itself; equal
    scores rank by ascending id, rows without id last. Other columns are not read.
    """
    kinds = f"{item_col} {items.schema[item_col].dataType.simpleString()}, rank int, {id_col} {docs.schema[id_col].dataType.simpleString()}, score long"
    names, each = graphs(items, item_col, item_text_col, block_terms)
    spark, found = docs.sparkSession, None
    for graph in each:
        postings = docs.select(id_col, text_col).mapInArrow(_postings_task(graph.terms), f"_id {docs.schema[id_col].dataType.simpleString()}, _n long, _t array<int>, _tf array<long>")
        postings = stage(postings.where("_n > 0"), "postings")
        documents, length = postings.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
        holding = np.zeros(len(graph.terms), np.int64)
        counted = postings.select(F.explode("_t").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
        holding[counted["t"].to_numpy()] = counted["df"].to_numpy()
        weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * holding + 1))).astype(np.int64)
        best = postings.mapInArrow(_score_task(graph, weights, documents, max(1, length), k), "_row long, _id long, _score long")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], kinds)
    first = [F.col("_score").desc(), F.col("_id").asc_nulls_last()]
    # the best of some tasks each, then of all
    some = found.withColumn("_salt", F.spark_partition_id() % 64)
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy("_row", "_salt").orderBy(*first))).where(F.col("_r") <= k)
    ranked = some.withColumn("_rank", F.row_number().over(Window.partitionBy("_row").orderBy(*first))).where(F.col("_rank") <= k)
    kind = docs.schema[id_col].dataType
    return ranked.join(names, "_row").select(F.col("_item").alias(item_col), F.col("_rank").alias("rank"), F.col("_id").cast(kind).alias(id_col), F.col("_score").alias("score"))
