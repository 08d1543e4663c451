"""A trie of conversations by their first turns: a global sort, adjacent common prefixes, a sweep with a stack, and stacks stitched across partitions."""

from __future__ import annotations

import hashlib
from math import ceil

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.llm.common import sized, written

TURN = 24  # bytes of a turn in a path: the MD5 of role and text, and the bytes of the text
PART = 4 << 20  # bytes of paths that a partition sweeps
FAN = 64  # neighbouring fragments that a task stitches

_NONE = (1 << 63) - 1  # no member yet
SWEPT = (
    "closed boolean, fragment bigint, seq bigint, spine boolean, key binary, parent_key binary, depth bigint, size bigint, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, piece binary"
)
NAMES = [c.split()[0] for c in SWEPT.split(", ")]
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_arrays(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, base, path): each conversation's turns by their number, null first, as TURN bytes each. ``base`` is conv_id less its remainder by 5.

    A null role or text is empty; rows without a conv_id belong to no conversation. Turns that share a number come by their bytes in the path.
    Texts are digested before they move. Paths compare as their arrays of turns would, as all turns are of one length.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    one = F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")), F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0"))
    conv = F.col(conv_col).cast("bigint")
    rows = turns.select((conv - conv % 5).alias("base"), conv.alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.unhex(one).alias("one")).alias("at")).where("conv_id IS NOT NULL")
    each = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    return each.select("conv_id", "base", F.unhex(F.array_join(F.transform("ats", lambda x: F.hex(x["one"])), "")).alias("path"))


def kept_turns(conv: Column) -> Column:
    """How many of its first turns a conversation takes from its base."""
    return (F.crc32(conv.cast("string").cast("binary")) % 9).cast("int")


def rebuilt(arrays: DataFrame) -> DataFrame:
    """(conv_id, path): the first turns of the conversation ``base``, as many as ``kept_turns`` says or there are, then the own ones behind its first so many."""
    n = kept_turns(F.col("conv_id")) * TURN
    of_base = F.first(F.when(F.col("conv_id") == F.col("base"), F.substring("path", 1, 8 * TURN)), ignorenulls=True).over(W.partitionBy("base"))
    with_base = arrays.withColumn("first", F.coalesce(of_base, F.lit(b""))).withColumn("n", n)
    return with_base.selectExpr("conv_id", "concat(substring(first, 1, n), substring(path, n + 1)) AS path")


class Stack:
    """A sweep over nodes in the order of their first sequences. A node closes when the sweep leaves it; its figures then go to its parent.

    What lies on the first sequence (``spine``) may go on in the part before and never closes here, nor does what is open at the end: these are
    the open nodes, whose figures are those of this part alone, without their open children's.
    """

    def __init__(self):
        self.up, self.key, self.depth, self.size, self.conv, self.n, self.children, self.leaves, self.saved, self.spine, self.closed = ([] for _ in range(11))
        self.ends: dict[int, bytes] = {}
        self.open: list[int] = []  # from the root

    def push(self, key: bytes, size: int, spine: bool) -> int:
        i = len(self.up)
        self.up.append(self.open[-1] if self.open else -1)
        self.depth.append(len(self.open))
        for values, value in ((self.key, key), (self.size, size), (self.conv, _NONE), (self.n, 0), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.spine, spine), (self.closed, False)):
            values.append(value)
        self.open.append(i)
        return i

    def add(self, i: int, conv: int, n: int, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.conv[i] = min(self.conv[i], conv)
        self.n[i] += n
        self.children[i] += children
        self.leaves[i] += leaves
        self.saved[i] += saved

    def leave(self, depth: int) -> None:
        """Closes what is at this depth or deeper."""
        while len(self.open) > depth:
            i = self.open.pop()
            if self.spine[i]:
                continue
            self.closed[i] = True
            self.leaves[i] = self.leaves[i] or 1
            self.saved[i] += (self.n[i] - 1) * self.size[i]
            if self.up[i] >= 0:
                self.add(self.up[i], self.conv[i], self.n[i], 1, self.leaves[i], self.saved[i])

    def table(self, fragment: int, hashed: bool) -> pa.RecordBatch:
        """All nodes as SWEPT rows. ``hashed``: closed nodes get the hash of their ends, open ones keep these as a piece."""
        every = range(len(self.up))
        up = lambda of, there: [of[u] if u >= 0 and self.closed[u] == there else None for u in self.up]
        ends = [self.ends.get(i, b"") for i in every]
        columns = {
            "closed": self.closed, "fragment": [fragment] * len(every), "seq": list(every), "spine": self.spine, "key": self.key, "parent_key": up(self.key, False), "depth": self.depth, "size": self.size,
            "conv_id": self.conv, "parent_conv_id": up(self.conv, True), "n_convs": self.n, "n_children": self.children, "n_leaves": self.leaves, "saved_tokens": self.saved,
            "ends_sha256": [hashlib.sha256(e).hexdigest() if hashed and c else None for e, c in zip(ends, self.closed)], "piece": [e if e and not c else None for e, c in zip(ends, self.closed)],
        }
        kinds = {"closed": pa.bool_(), "spine": pa.bool_(), "key": pa.binary(), "parent_key": pa.binary(), "ends_sha256": pa.string(), "piece": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64())) for c in NAMES], names=NAMES)


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    n = min(len(a), len(b)) // TURN
    if a[: n * TURN] == b[: n * TURN]:
        return n
    low, high = 0, n - 1  # the first ``low`` are shared, of the first ``high + 1`` one isn't
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN] else (low, mid - 1)
    return low


def _swept(batches):
    """The nodes of a partition's sorted (path, conv_id), open ones too."""
    stack, before, run, at = Stack(), None, [], 0
    for batch in batches:
        for path, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if path != before:
                if before is not None:
                    stack.ends[at] = b",".join(run)
                shared = -1 if before is None else _common(before, path)
                stack.leave(shared + 1)
                for depth in range(shared + 1, len(path) // TURN + 1):
                    turn = path[(depth - 1) * TURN : depth * TURN] if depth else b""
                    key = hashlib.blake2b(stack.key[stack.open[-1]] + turn, digest_size=16).digest() if depth else bytes(16)
                    stack.push(key, int.from_bytes(turn[16:], "big"), before is None)
                before, run, at = path, [], stack.open[-1]
            stack.add(at, conv, 1)
            run.append(b"%d" % conv)
    if before is not None:
        stack.ends[at] = b",".join(run)
        yield stack.table(TaskContext.get().partitionId(), True)


def _stitch(last: bool, fan: int):
    """A function of a group: the open nodes of neighbouring fragments as one fragment: equal ones are one, and what lies between closes; all, if there are no others."""

    def stitched(group: pa.Table) -> pa.Table:
        return _stitched(group, last, fan)

    return stitched


def _stitched(group: pa.Table, last: bool, fan: int) -> pa.Table:
    rows = group.sort_by([("fragment", "ascending"), ("seq", "ascending")]).to_pylist()
    stack = Stack()
    for r in rows:
        depth = r["depth"]
        if len(stack.open) > depth and stack.key[stack.open[depth]] == r["key"]:
            i = stack.open[depth]
        else:
            stack.leave(depth)
            i = stack.push(r["key"], r["size"], r["spine"] and r["fragment"] == rows[0]["fragment"] and not last)
        stack.add(i, r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"])
    if last:
        stack.leave(0)
    return pa.Table.from_batches([stack.table(rows[0]["fragment"] // fan, False)])


def _hashed(batches):
    """(key, hash) of the pieces of each key, which come in order; a piece is read at a time."""
    key, hash_ = None, None
    for batch in batches:
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    yield pa.RecordBatch.from_pydict({"key": [key], "sha": [hash_.hexdigest()]})
                key, hash_ = k, hashlib.sha256(piece)
            else:
                hash_.update(b"," + piece)
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "sha": [hash_.hexdigest()]})


def prefix_trie(paths: DataFrame, part: int = PART, fan: int = FAN) -> DataFrame:
    """A row for each different sequence of first turns of (conv_id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The rows are sorted globally, by path and conv_id, so that a large group of copies is cut too. Each partition is swept once; nodes on its first and
    last path stay open. These few are stitched, ``fan`` neighbouring partitions at a time, in rounds, until one fragment is left. Children of open nodes get
    their parent's conv_id by a join at the end. The ids that end in an open node go as pieces, one a partition, to one stream for each node, as SHA-256 can't be taken in parts.

    A turnless conversation ends in the root. A conv_id that comes twice counts twice. Without conversations there are no rows, the root included.
    A path is held whole (TURN bytes a turn), and a partition's nodes are held as numbers; ``part`` bounds these; ``fan`` is 2 at least.
    """
    rows = written(paths.select("path", "conv_id"), "paths")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("path") + 64), F.lit(0)).cast("bigint")).first()[0]
    parts = max(ceil(size / part), min(rows.sparkSession.sparkContext.defaultParallelism, ceil(size / (1 << 16))), 1)
    swept = written(rows.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_swept, SWEPT), "swept")
    open_, stitched, fragments = swept.where("NOT closed"), None, (swept.agg(F.max("fragment")).first()[0] or 0) + 1
    while True:
        fragments = ceil(fragments / fan)
        last = fragments == 1
        each = written(open_.groupBy((F.col("fragment") / fan).cast("bigint")).applyInArrow(_stitch(last, fan), SWEPT), "stitched")
        stitched = each.where("closed") if stitched is None else stitched.unionByName(each.where("closed"))
        open_ = each.where("NOT closed")
        if last:
            break
    pieces = swept.where("piece IS NOT NULL").select("key", "piece", "fragment").repartition("key").sortWithinPartitions("key", "fragment")
    hashes = pieces.select("key", "piece").mapInArrow(_hashed, "key binary, sha string")
    nothing = F.lit(hashlib.sha256().hexdigest())
    stitched = written(stitched.join(hashes, "key", "left").withColumn("ends_sha256", F.coalesce("sha", nothing)).drop("sha"), "stitched-nodes")
    closed = swept.where("closed").unionByName(stitched)
    parents = stitched.select(F.col("key").alias("of"), F.col("conv_id").alias("found"))
    below = closed.where("parent_key IS NOT NULL").join(sized(parents), F.col("parent_key") == F.col("of"), "left").withColumn("parent_conv_id", F.col("found"))
    return closed.where("parent_key IS NULL").select(_NODE).unionByName(below.select(_NODE))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all conversations, as ``turn_arrays`` and ``prefix_trie`` say it for nulls, ties and repeated rows."""
    return prefix_trie(rebuilt(turn_arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE = """
WITH arrays AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns,
        xor(4294967295, list_reduce(
            list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 AS h
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS path FROM arrays c LEFT JOIN arrays b ON b.conv_id = c.conv_id - c.conv_id % 5),
members AS (SELECT conv_id, len(path) AS length, depth, path[1:depth] AS prefix FROM (SELECT *, unnest(range(len(path) + 1)) AS depth FROM rebuilt)),
nodes AS (
    SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(strlen(prefix[-1].text), 0) AS size,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256
    FROM members GROUP BY prefix, depth
),
families AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
children AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT f.*, coalesce(n_children, 0) AS n_children FROM families f LEFT JOIN children c ON c.depth = f.depth AND c.prefix = f.prefix),
subtrees AS (
    SELECT prefix[1:top] AS prefix, top AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
    FROM (SELECT *, unnest(range(depth + 1)) AS top FROM counted) GROUP BY ALL
)
SELECT conv_id, c.depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted c JOIN subtrees s ON s.depth = c.depth AND s.prefix = c.prefix
"""
