"""Spelling variants: k-d trees over letter-count vectors, and forms of words.

Two words are near if one inserted, deleted or replaced letter turns one into the other.  The vector of a word counts
its letters; a replaced letter moves one count down and one up, an inserted one moves one up.  So words near a word
lie at an L1 distance of two in its own length, or of one in the next.

The words of each length are split by a k-d tree on these counts.  A search walks down a tree and leaves out every
box that the word cannot reach: it may go below the cut of one axis by one and above that of one other by one (for the
next length: above one by one).  Of a pair of equal length only the word whose letter at the place of difference is
smaller searches, so each pair is found once.  What shares a leaf is held against packed counts, then letter by letter.

Spark deals the work by two tiers of the same tree.  A coarse one, built on the driver from a sample of about
``SAMPLE`` words (a word that is not in the sample still has its leaf), sends every word to its own leaf as a point and to all
leaves that it reaches as a query.  A leaf with more points or queries than ``GROUP`` is cut into blocks of either, and each
block of points meets each block of queries.  Every such group then builds its own tree, to leaves of a few words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.llm.ship import ship
from boxmill.operators.skew import lookup_join
from boxmill.session import settle

SAMPLE, SAMPLE_LETTERS = 65_536, 64
COARSE = 8192  # points of a coarse leaf, about
GROUP = 32_768  # points, or queries, of a group, about
FINE = 12  # points of a leaf of a group's own tree
BLOCK = 1 << 19  # candidate pairs handled together

# fixed values: letters are a to z and the code points C0 to FF
LETTERS = 26 + 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
CLOSED, OPEN = -2, LETTERS


def letters(words: list[str], length: int) -> np.ndarray:
    """Letter numbers, in code-point order, of words of one length: (words, length)."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
    return np.where(code < 128, code - 97, code - 0xC0 + 26).astype(np.int16).reshape(len(words), length)


def counts(table: np.ndarray) -> np.ndarray:
    """Letter-count vectors of the rows."""
    n, length = table.shape
    flat = table.astype(np.int64) + np.arange(n)[:, None] * LETTERS
    found = np.bincount(flat.ravel(), minlength=n * LETTERS).reshape(n, LETTERS)
    return found.astype(np.uint8 if length < 256 else np.int32)


def _packed(vectors: np.ndarray) -> np.ndarray:
    """64 bits a vector, of which each letter more or less changes one at most."""
    bits = np.zeros((len(vectors), 64), bool)
    bits[:, :26] = vectors[:, :26] > 0
    bits[:, 26:52] = vectors[:, :26] > 1
    for k in range(12):
        bits[:, 52 + k] = vectors[:, 26 + k :: 12].sum(axis=1) & 1
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def build(points: np.ndarray, limit: float) -> tuple[dict, np.ndarray]:
    """(tree, leaf of every point).  A leaf has at most ``limit`` points, or only equal ones.

    ``axis`` is -1 at a leaf; otherwise points with a count over ``cut`` go to child + 1, others to child.
    """
    axis, cut, child = [-1], [0], [0]
    leaf = np.zeros(len(points), np.int64)
    waiting = [(0, np.arange(len(points)))]
    while waiting:
        node, own = waiting.pop()
        if len(own) <= limit:
            continue
        held = points[own]
        # the cut that parts the points most evenly
        shares = np.stack([np.count_nonzero(held > t, axis=0) for t in range(3)])
        uneven = np.abs(2 * shares - len(own))
        t, a = np.unravel_index(int(uneven.argmin()), uneven.shape)
        if uneven[t, a] == len(own):
            low, high = held.min(axis=0).astype(int), held.max(axis=0).astype(int)
            a = int((high - low).argmax())
            if low[a] == high[a]:
                continue
            t = (low[a] + high[a]) // 2
        above = held[:, a] > t
        axis[node], cut[node], child[node] = int(a), int(t), len(axis)
        for k, part in enumerate((own[~above], own[above])):
            leaf[part] = len(axis)
            waiting.append((len(axis), part))
            axis.append(-1), cut.append(0), child.append(0)
    tree = {"axis": np.array(axis, np.int16), "cut": np.array(cut, np.int32), "child": np.array(child, np.int32)}
    return tree, leaf


def home(tree: dict, vectors: np.ndarray) -> np.ndarray:
    """The leaf of every vector."""
    node = np.zeros(len(vectors), np.int64)
    while len(on := np.flatnonzero(tree["axis"][node] >= 0)):
        at = node[on]
        node[on] = tree["child"][at] + (vectors[on, tree["axis"][at]] > tree["cut"][at])
    return node


def reach(tree: dict, vectors: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """(vector, leaf) of all leaves that can hold a near word: of the next length if ``longer``, else of the same.

    A walker remembers the axis on which it is one over its box (a lost letter) and that on which it is one under (a won
    one); it may have one of each, the lost letter being the smaller.  A cut is met by one count on either side only, so
    no box within reach is left out.
    """
    who, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    lost = np.full(len(vectors), CLOSED if longer else -1, np.int16)
    won = np.full(len(vectors), OPEN, np.int16)
    found_who, found_leaf = [who[:0]], [node[:0]]
    while len(who):
        axis = tree["axis"][node]
        ended = axis < 0
        if ended.any():
            found_who.append(who[ended])
            found_leaf.append(node[ended])
            who, node, lost, won, axis = (x[~ended] for x in (who, node, lost, won, axis))
        over = vectors[who, axis].astype(np.int32) - tree["cut"][node]
        child = tree["child"][node]
        down = (over <= 0) | (over == 1) & (lost == -1) & (axis < won)
        up = (over > 0) | (over == 0) & (won == OPEN) & (axis > lost)
        who, node, lost, won = (
            np.concatenate(x)
            for x in (
                (who[down], who[up]),
                (child[down], child[up] + 1),
                (np.where(over > 0, axis, lost)[down], lost[up]),
                (won[down], np.where(over <= 0, axis, won)[up]),
            )
        )
    return np.concatenate(found_who), np.concatenate(found_leaf)


def _same_length(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rows that differ in one place, where ``q`` has the smaller letter."""
    differs = q != p
    one = differs.sum(axis=1) == 1
    at = differs.argmax(axis=1)
    k = np.arange(len(q))
    return one & (q[k, at] < p[k, at])


def _one_longer(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rows of ``p`` that are those of ``q`` with one letter put in."""
    length = q.shape[1]
    front = np.where((off := q != p[:, :length]).any(axis=1), off.argmax(axis=1), length)
    back = np.where((off := (q != p[:, 1:])[:, ::-1]).any(axis=1), off.argmax(axis=1), length)
    return front + back >= length


def links(points: list[str], queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) of all near pairs; points have one length, queries that length, or all one less.

    Of pairs of equal length those are given whose query has the smaller letter where they differ.
    """
    none = np.zeros(0, np.int64)
    if not points or not queries:
        return none, none
    longer = len(queries[0]) < len(points[0])
    p_table, q_table = letters(points, len(points[0])), letters(queries, len(queries[0]))
    p_counts = counts(p_table)
    tree, leaf = build(p_counts, FINE)
    order = np.argsort(leaf, kind="stable")
    sizes = np.bincount(leaf, minlength=len(tree["axis"]))
    first = np.cumsum(sizes) - sizes
    p_bits = _packed(p_counts)
    check, bits = (_one_longer, 1) if longer else (_same_length, 2)
    found_q, found_p = [none], [none]
    letters_at_once = max(1, BLOCK * 16 // len(points[0]))
    for low in range(0, len(queries), 4096):
        q_counts = counts(q_table[low : low + 4096])
        q_bits = _packed(q_counts)
        who, at = reach(tree, q_counts, longer)
        ends = np.cumsum(sizes[at])
        begin = 0
        while begin < len(who):
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
            part, n = at[begin:stop], sizes[at[begin:stop]]
            # a leaf of many equal points is one entry with as many candidates
            for shift in range(0, int(n.max()), BLOCK):
                own = np.clip(n - shift, 0, BLOCK)
                inside = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
                p = order[np.repeat(first[part] + shift, own) + inside]
                q = np.repeat(who[begin:stop], own)
                near = np.flatnonzero(np.bitwise_count(q_bits[q] ^ p_bits[p]) <= bits)
                q, p = q[near], p[near]
                for k in range(0, len(q), letters_at_once):
                    a, b = q[k : k + letters_at_once] + low, p[k : k + letters_at_once]
                    true = check(q_table[a], p_table[b])
                    found_q.append(a[true])
                    found_p.append(b[true])
            begin = stop
    return np.concatenate(found_q), np.concatenate(found_p)


def forest(sample: list[str], scale: float) -> dict[int, dict]:
    """Coarse tree of each length; a word of the sample stands for ``scale`` words."""
    by_length: dict[int, list[str]] = {}
    for word in sample:
        by_length.setdefault(len(word), []).append(word)
    # no cut is fitted to fewer than a few words of the sample
    limit = max(COARSE / scale, 4)
    return {n: build(counts(letters(own, n)), limit)[0] for n, own in by_length.items()}


_TREE = {"axis": np.array([-1], np.int16), "cut": np.zeros(1, np.int32), "child": np.zeros(1, np.int32)}
POINT, SAME, SHORTER = 0, 1, 2


def _routed(batches, trees: dict[int, dict]):
    """(length, leaf, kind, word, n): each word as a point, and as a query where it may have near words."""
    for batch in batches:
        column, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        size = np.fromiter(map(len, column), np.int64, len(column))
        words = np.array(column, object)
        for length in np.unique(size).tolist():
            every = np.flatnonzero(size == length)
            step = max(1, (1 << 22) // length)
            for own in (every[k : k + step] for k in range(0, len(every), step)):
                vectors = counts(letters(words[own].tolist(), length))
                here, next_one = trees.get(length, _TREE), trees.get(length + 1, _TREE)
                parts = [
                    (POINT, length, np.arange(len(own)), home(here, vectors)),
                    (SAME, length, *reach(here, vectors, False)),
                    (SHORTER, length + 1, *reach(next_one, vectors, True)),
                ]
                for kind, target, who, leaf in parts:
                    for low in range(0, len(who), 65_536):
                        some, to = own[who[low : low + 65_536]], leaf[low : low + 65_536]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(some), target, np.int64)),
                                pa.array(to.astype(np.int64)),
                                pa.array(np.full(len(some), kind, np.int32)),
                                pa.array(words[some], pa.string()),
                                pa.array(n[some]),
                            ],
                            ["length", "leaf", "kind", "word", "n"],
                        )


def _group_links(table: pa.Table) -> pa.Table:
    """Near words inside a group: for every word that has any their number, and the best of them."""
    kind = table.column("kind").to_numpy()
    words, n = np.array(table.column("word").to_pylist(), object), table.column("n").to_numpy()
    points = np.flatnonzero(kind == POINT)
    a, b = [], []
    for role in (SAME, SHORTER):
        own = np.flatnonzero(kind == role)
        q, p = links(words[points].tolist(), words[own].tolist())
        a.append(own[q])
        b.append(points[p])
    one, two = np.concatenate(a), np.concatenate(b)
    word, near = np.concatenate([one, two]), np.concatenate([two, one])
    spelled, name = np.unique(words, return_inverse=True)  # Python orders texts by code points
    order = np.lexsort((name[near], -n[near], name[word]))
    own = name[word][order]
    head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else own
    best = near[order][head]
    return pa.table(
        {
            "word": pa.array(spelled[own[head]], pa.string()),
            "n_near": pa.array(np.diff(np.append(head, len(own))).astype(np.int64)),
            "best_n": pa.array(n[best].astype(np.int64)),
            "best": pa.array(words[best], pa.string()),
        }
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word that has near ones, for a written table word, n of distinct words.

    ``best`` is the near word of largest n, ties to the smallest in code-point order.  Words consist of a to z and the
    code points C0 to FF; NULL words take no part.
    """
    ship()
    spark = words.sparkSession
    total = words.count()
    # one draw a word, so that no task sends more than its share to the driver
    draw = F.pmod(F.xxhash64("word", F.lit("sample")), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / max(total, 1)))
    drawn = words.where((F.char_length("word") <= SAMPLE_LETTERS) & draw).select("word").collect()
    trees = forest([r["word"] for r in drawn], max(1.0, total / max(len(drawn), 1)))
    held = spark.sparkContext.broadcast(trees)  # at most as many cuts as the sample has words, about SAMPLE
    clean = words.where("word is not null and word <> ''").select("word", F.col("n").cast("long"))
    schema = "length long, leaf long, kind int, word string, n long"
    routed = settle(clean.mapInArrow(lambda batches: _routed(batches, held.value), schema))
    # blocks of leaves that outgrew their share; one row per leaf, of which there are few over the limit
    sizes = routed.groupBy("length", "leaf").agg(
        F.count(F.when(F.col("kind") == POINT, 1)).alias("points"), F.count(F.when(F.col("kind") != POINT, 1)).alias("queries")
    )
    large = settle(sizes.where(f"points > {GROUP} or queries > {4 * GROUP}"))
    blocks = [F.coalesce(F.ceil(F.col(c) / F.lit(float(k * GROUP))), F.lit(1)).cast("int") for c, k in (("points", 1), ("queries", 4))]
    dealt = routed.join(F.broadcast(large), ["length", "leaf"], "left").withColumns({"_p": blocks[0], "_q": blocks[1]})
    mine = F.pmod(F.xxhash64("word", F.lit("block")), F.when(F.col("kind") == POINT, F.col("_p")).otherwise(F.col("_q"))).cast("int")
    others = F.sequence(F.lit(0), F.greatest(F.when(F.col("kind") == POINT, F.col("_q")).otherwise(F.col("_p")), F.lit(1)) - 1)
    spread = dealt.select("length", "leaf", "kind", "word", "n", mine.alias("_mine"), F.explode(others).alias("_other"))
    is_point = F.col("kind") == POINT
    placed = spread.select(
        "length", "leaf", "kind", "word", "n",
        F.when(is_point, F.col("_mine")).otherwise(F.col("_other")).alias("p"),
        F.when(is_point, F.col("_other")).otherwise(F.col("_mine")).alias("q"),
    )
    found = placed.groupBy("length", "leaf", "p", "q").applyInArrow(
        _group_links, "word string, n_near long, best_n long, best string"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    joined = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return joined.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3, drop: int = 97) -> DataFrame:
    """(word, n) of the words of the whole texts that have ``shortest`` letters and ``least`` occurrences at least.

    Words are runs of A to Z, a to z and the code points C0 to FF, with A to Z lower-cased.  Where ``drop`` divides the
    crc32 of "key:run", the letter of the run with that number (modulo its length) is left out first; 0 leaves all.
    A NULL text has no words; a NULL key counts as the empty text.
    """
    lowered = F.translate(F.col(text).cast("string"), _UPPER, _LOWER)
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    word = F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("word")
    found = docs.select(name.alias("_key"), word)
    if drop:
        mark = F.crc32(F.concat("_key", F.lit(":"), "word").cast("binary"))
        marked = found.select("word", mark.alias("_h"))
        at = F.pmod(F.col("_h"), F.char_length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        found = marked.select(F.when(F.col("_h") % drop == 0, less).otherwise(F.col("word")).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n")).where((F.char_length("word") >= shortest) & (F.col("n") >= least))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a written table word, form without circles: every step doubles how far a word has come."""
    state = settle(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not state.where("moved").isEmpty():
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        on = lookup_join(state.drop("moved"), ahead, ["root"], "left", written=True)
        state = settle(on.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
    return state.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of a table word, n of distinct words.

    ``form`` is the near word of largest n (ties: smallest in code-point order) if its n is at least ``ratio`` times
    the word's; else NULL, and so is ``form_n``.  ``root`` is where following forms ends; n grows on the way, so it does.
    An empty table gives an empty table.
    """
    if ratio < 2:
        raise ValueError("forms need a ratio of 2 at least")
    words = settle(words.select("word", F.col("n").cast("long")))
    near = settle(near_words(words))
    taken = F.col("best_n") >= ratio * F.col("n")
    with_near = settle(
        lookup_join(words, near, ["word"], "left", written=True).select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n"),
        )
    )
    roots = _roots(with_near.where("form is not null"))
    found = lookup_join(with_near, roots, ["word"], "left", written=True)
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
