"""Language-model scores from a weighted backoff automaton over smoothed n-grams of up to three words.

The model: P(w) = (c(w) + 1) / (N + V + 1), then P(w | v) = (c(vw) + K P(w)) / (c(v) + K) and
P(w | uv) = (c(uvw) + K P(w | v)) / (c(uv) + K). As an automaton: the root, counted words and counted pairs are
states. A counted run of words is an arc from the state of all its words but the last, with the log of its
probability, to the state of its last two words. Other words take the failure arc, of weight log(K / (c + K)), from a
pair to its second word and from a word to the root, which has an arc for each word. Before its first token a
text stands in the state of an end.

The counts of all training documents come through scatter in two rounds. Words and pairs first; then those triples whose
pairs both occur in other chunks too, as all others are counted in full by their own chunk. A chunk builds the part of the automaton that its own runs can reach. Whatever came before, the state after a token is
the longest counted run of two words at most that ends there; so the states of all places are known at once,
and the places of all texts take arcs and failure arcs side by side. A text's score adds up their weights from left to right.

Weights are doubles, added up without rounding, so that no order of addition makes a difference. Null and empty texts are one token, the end. Keys are 52-bit hashes of words and runs: of n distinct runs some n^2 / 2^53 pairs
share a count, 1 in 10^8 runs and a hundred in 10^9.
Rows with the same id, or a null one, are scored each by itself; other columns are not read. Where train is null the row
is held out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import flat, scatter

K = 4.0
COARSE, FINE = 2.0**-20, 2.0**-52  # of what logarithms are multiples when they are added up
_U = np.uint64
#: The key of the end, which is no word's hash of at least one byte but by chance.
END = flat.mix(np.array([0x656E64], _U))[0]
DROP = 10  # bits of a key that aren't sent; the two above them tell words, pairs and triples apart
_RESULT = pa.schema([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, each row's end last, and the n + 1 offsets of the rows."""
    words, rows = flat.word_hashes(data, offsets, flat.SOLID_BYTE)
    return np.insert(words, rows[1:], END), rows + np.arange(len(rows))


def longer(runs: np.ndarray, keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The key of each token after the run that ends at the one before; before a row's first stands an end."""
    before = np.empty(len(keys), _U)
    before[1:] = runs[:-1]
    before[edges[:-1]] = END
    return flat.mix(before * _U(0xD6E8FEB86659FD93) + keys * _U(2) + _U(1))


def _marked(keys: np.ndarray, words: int) -> np.ndarray:
    """Keys without the bits that aren't sent, marked with the number of their words."""
    return (keys & ~_U((4 << DROP) - 1)) | _U(words << DROP)


class Automaton:
    """The states and arcs that one chunk's runs reach. States are numbered: words, pairs, the root. An arc has the number of the
    run that it completes: words, pairs, triples."""

    def __init__(self, one: np.ndarray, two: np.ndarray, three: np.ndarray, pair: np.ndarray, triple: np.ndarray, total: int, distinct: int, k: float = K):
        """one, two, three: the counts of distinct runs. pair: first and second word of each pair; triple: first and second pair of each triple."""
        words = len(one)
        self.root = root = words + len(two)
        contexts = np.concatenate([one, two])
        p = np.empty(root + len(three))
        p[:words] = (one + 1) / (total + distinct + 1)
        p[words:root] = (two + k * p[pair[1]]) / (one[pair[0]] + k)
        p[root:] = (three + k * p[words + triple[1]]) / (two[triple[0]] + k)
        #: Whether there is such an arc: the run was counted, or it is a word, as the root has an arc for each.
        self.arc = np.concatenate([np.ones(words, bool), two > 0, three > 0])
        self.weight = _logs(p, self.arc)
        #: Each state's failure arc: its weight and where it leads.
        self.fail = np.concatenate([_logs(k / (contexts + k), contexts > 0), np.zeros((1, 2), np.int64)])
        word_state = np.where(one > 0, np.arange(words), root)
        self.back = np.concatenate([np.full(words, root), word_state[pair[1]]])
        #: The number of words of each state's run.
        self.size = np.repeat([1, 2, 0], [words, len(two), 1])
        #: The state after each word, if nothing longer that ends there was counted, and after each pair.
        self.after_word, self.after_pair = word_state, np.where(two > 0, words + np.arange(len(two)), word_state[pair[1]])

    def walk(self, state: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """What each place adds to its text's score. state: where each stands before its token; runs: the numbers, as arcs, of
        the runs of one, two and three words that end with it."""
        out, live = np.zeros((len(state), 2), np.int64), np.arange(len(state))
        while len(live):
            arc = runs[self.size[state], live]
            taken = self.arc[arc]
            out[live[taken]] += self.weight[arc[taken]]
            live, state = live[~taken], state[~taken]
            out[live] += self.fail[state]
            state = self.back[state]
        return out


def _logs(p: np.ndarray, which: np.ndarray) -> np.ndarray:
    """log10 as multiples of COARSE and of FINE, 0 where not which: what is left of a double then is at most half of FINE, and the two are added up without any
    rounding, so no order matters. The C library's, as numpy's differs in the last bit."""
    out = np.zeros((len(p), 2), np.int64)
    logs = np.fromiter(map(math.log10, p[which].tolist()), np.float64)
    out[which, 0] = coarse = np.floor(logs / COARSE)
    out[which, 1] = np.floor((logs - coarse * COARSE) / FINE + 0.5)
    return out


class Runs:
    """The words, pairs and triples of a chunk: distinct ones by their keys, and at each place the numbers of those that end there."""

    def __init__(self, table: pa.Table):
        keys, self.edges = tokens(*flat.flat(table.column("text")))
        pairs = longer(keys, keys, self.edges)
        self.starts = self.edges[:-1]
        inner = np.ones(len(keys), bool)
        inner[self.starts] = False
        self.inner = np.flatnonzero(inner)  # where a triple ends
        triples = longer(pairs, keys, self.edges)[self.inner]
        found = [np.unique(_marked(x, k), return_index=True, return_inverse=True) for k, x in enumerate((keys, pairs, triples), 1)]
        self.keys, self.first, self.at = zip(*found, strict=True)
        self.trained = np.repeat(table.column("_train").to_numpy(), np.diff(self.edges))
        self.own = [np.bincount(at[t], minlength=len(k)) for k, at, t in zip(self.keys, self.at, (self.trained, self.trained, self.trained[self.inner]), strict=True)]
        both = np.concatenate(self.keys[:2])
        self.order = np.argsort(both, kind="stable")
        self.short = both[self.order]  # keys of words and pairs, as the first round asks for them
        self.end = int(np.searchsorted(self.keys[0], _marked(np.array([END]), 1)[0]))

    def totals(self, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of words and of pairs, and which triples other chunks may have, too."""
        every, several = np.empty(len(self.order), np.int64), np.empty(len(self.order), bool)
        every[self.order], several[self.order] = scatter.in_order(told)
        words = len(self.keys[0])
        first, second = self.pairs_of_triples()
        return every[:words], every[words:], several[words:][first] & several[words:][second]

    def pairs_of_triples(self) -> tuple[np.ndarray, np.ndarray]:
        place = self.inner[self.first[2]]
        return self.at[1][place - 1], self.at[1][place]

    def words_of_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        before = np.empty(len(self.at[0]), np.int64)
        before[1:] = self.at[0][:-1]
        before[self.starts] = self.end
        return before[self.first[1]], self.at[0][self.first[1]]


def score(docs: DataFrame, train: F.Column, *, doc_id: str = "doc_id", text: str = "text", k: float = K, **layout) -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words alone) and score; train is a condition."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("_train"))
    chunks, layout = scatter.chunked(docs, "text", "doc_id", **layout)

    def short(table: pa.Table):
        runs = Runs(table)
        return runs.short, np.concatenate(runs.own[:2])[runs.order]

    def long(table: pa.Table, told: pa.Table):
        runs = Runs(table)
        _, _, asked = runs.totals(told)
        return runs.keys[2][asked], runs.own[2][asked]

    def totals(table: pa.Table) -> pa.Table:
        keys, counts = scatter.unpacked(scatter.by_sender(table, "_from")[1], DROP)
        own, total, _, _ = scatter.merged(keys, counts)
        words = total[(own >> _U(DROP)) & _U(3) == 1]
        return pa.table({"n": pa.array([int(words.sum())], pa.int64()), "v": pa.array([int((words > 0).sum())], pa.int64())})

    told_short, leaves = scatter.sums(chunks, short, layout, DROP)
    told_long, _ = scatter.sums(chunks, long, layout, DROP, told_short)
    whole = leaves.groupBy("_to").applyInArrow(totals, "n long, v long").agg(F.struct(F.sum("n").alias("n"), F.sum("v").alias("v")).alias("t"))

    def walk(table: pa.Table, told: pa.Table) -> pa.Table:
        runs = Runs(table)
        one, two, asked = runs.totals(scatter.of_round(told, 0))
        three = runs.own[2].copy()
        three[asked], _ = scatter.in_order(scatter.of_round(told, 1))
        t = told.column("_t")[0].as_py()
        automaton = Automaton(one, two, three, runs.words_of_pairs(), runs.pairs_of_triples(), t["n"], t["v"], k)
        word, pair = runs.at[:2]
        state = np.empty(len(word), np.int64)
        state[1:] = automaton.after_pair[pair[:-1]]
        state[runs.starts] = automaton.after_word[runs.end]
        arcs = np.zeros((3, len(word)), np.int64)
        arcs[0], arcs[1] = word, len(one) + pair
        arcs[2, runs.inner] = automaton.root + runs.at[2]
        sums = [np.add.reduceat(x, runs.starts, axis=0) @ np.array([COARSE, FINE]) for x in (automaton.weight[word], automaton.walk(state, arcs))]
        known = np.add.reduceat((one[word] > 0).astype(np.int64), runs.starts)
        return pa.Table.from_arrays([table.column("doc_id"), pa.compute.invert(table.column("_train")), pa.array(np.diff(runs.edges)), pa.array(known), pa.array([t["n"]] * len(table), pa.int64()), *map(pa.array, sums)], ["doc_id", "held_out", *_RESULT.names])

    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return scatter.beside(chunks, [told_short, told_long], layout, walk, fields, _t=whole.scalar())


def op10(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2)


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), NULL) AS w,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT))), 4294967295::BIGINT) % 7 = 2 AS held_out FROM documents),
t AS (SELECT r, held_out, p, w[p] AS z, CASE WHEN p > 1 THEN w[p - 1] END AS y, CASE WHEN p > 2 THEN w[p - 2] END AS x FROM (SELECT r, held_out, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
c1 AS (SELECT z, count(*) AS c FROM t WHERE NOT held_out GROUP BY z),
c2 AS (SELECT y, z, count(*) AS c FROM t WHERE NOT held_out GROUP BY y, z),
c3 AS (SELECT x, y, z, count(*) AS c FROM t WHERE NOT held_out AND p > 1 GROUP BY x, y, z),
g AS (SELECT sum(c) AS n, count(*) AS v FROM c1),
s AS (SELECT t.r, g.n AS n, coalesce(a.c, 0) AS z1, coalesce(b.c, 0) AS y1, coalesce(e.c, 0) AS z2, CASE WHEN t.p > 1 THEN coalesce(f.c, 0) ELSE 0 END AS y2, CASE WHEN t.p > 1 THEN coalesce(h.c, 0) ELSE 0 END AS z3, (coalesce(a.c, 0) + 1) / (g.n + g.v + 1) AS p1
  FROM t CROSS JOIN g LEFT JOIN c1 a ON t.z IS NOT DISTINCT FROM a.z LEFT JOIN c1 b ON t.y IS NOT DISTINCT FROM b.z LEFT JOIN c2 e ON t.z IS NOT DISTINCT FROM e.z AND t.y IS NOT DISTINCT FROM e.y
  LEFT JOIN c2 f ON t.y IS NOT DISTINCT FROM f.z AND t.x IS NOT DISTINCT FROM f.y LEFT JOIN c3 h ON t.z IS NOT DISTINCT FROM h.z AND t.y IS NOT DISTINCT FROM h.y AND t.x IS NOT DISTINCT FROM h.x),
q AS (SELECT *, (z2 + 4.0::DOUBLE * p1) / (y1 + 4.0::DOUBLE) AS p2, log10(p1) AS l1 FROM s),
l AS (SELECT r, z1, n, l1, CASE WHEN z3 > 0 THEN log10((z3 + 4.0::DOUBLE * p2) / (y2 + 4.0::DOUBLE)) WHEN y2 > 0 THEN log10(4.0::DOUBLE / (y2 + 4.0::DOUBLE)) ELSE 0 END AS a,
  CASE WHEN z3 > 0 THEN 0 WHEN z2 > 0 THEN log10(p2) WHEN y1 > 0 THEN log10(4.0::DOUBLE / (y1 + 4.0::DOUBLE)) ELSE 0 END AS b, CASE WHEN z3 > 0 OR z2 > 0 THEN 0 ELSE l1 END AS c FROM q),
-- Doubles are added up without rounding: in parts that are multiples of 2^-20 and of 2^-52.
o AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (z1 > 0) AS n_known, CAST(max(n) AS BIGINT) AS train_tokens,
  CAST(sum(CAST(floor(l1 * 1048576) AS BIGINT)) AS DOUBLE) / 1048576 + CAST(sum(CAST(floor((l1 - floor(l1 * 1048576) / 1048576) * 4503599627370496 + 0.5) AS BIGINT)) AS DOUBLE) / 4503599627370496 AS base_score,
  CAST(sum(CAST(floor(a * 1048576) AS BIGINT) + CAST(floor(b * 1048576) AS BIGINT) + CAST(floor(c * 1048576) AS BIGINT)) AS DOUBLE) / 1048576 + CAST(sum(CAST(floor((a - floor(a * 1048576) / 1048576) * 4503599627370496 + 0.5) AS BIGINT) + CAST(floor((b - floor(b * 1048576) / 1048576) * 4503599627370496 + 0.5) AS BIGINT) + CAST(floor((c - floor(c * 1048576) / 1048576) * 4503599627370496 + 0.5) AS BIGINT)) AS DOUBLE) / 4503599627370496 AS score FROM l GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM o JOIN d USING (r)
"""
