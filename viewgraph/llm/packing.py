"""Filling containers of fixed capacity.

The method: bounded-space online best-fit. Every task keeps a fixed number of open containers,
in a bitset keyed by free space, so that the fullest one into which an item fits is found by a
few operations on one integer. An item that fits nowhere opens a container; if too many are
open, the fullest is closed first. Items larger than the capacity are cut: they fill containers
of their own, and the remainder is placed like any item.

Items are dealt to streams of bounded length by a hash, so there is no hot group. A stream comes in the order of a hash, with
a look-ahead of WINDOW items, which are placed by falling size: large items open containers, small ones fill them and those that
are open from before. As a window opens fewer containers than may be open, none is closed before small items had their turn.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items in a stream, at most about; a stream is one task's work.
STREAM_ITEMS = 50_000
#: Items that a stream looks ahead.
WINDOW = 4096
#: Containers that a stream keeps open.
OPEN_CONTAINERS = 8192

PLACED = "kind string, item long, container string, piece int, n_pieces int, first_token long, n_tokens long"


class OpenContainers:
    """Open containers by free space: a bitset of the spaces that occur, and a stack for each."""

    def __init__(self, most: int):
        self.most, self.count = most, 0
        self.bits = 0
        self.stacks: dict[int, list[int]] = {}
        self.opened = 0

    def _take(self, space: int) -> int:
        stack = self.stacks[space]
        box = stack.pop()
        if not stack:
            self.bits ^= 1 << space
        self.count -= 1
        return box

    def _put(self, box: int, space: int) -> None:
        stack = self.stacks.setdefault(space, [])
        if not stack:
            self.bits |= 1 << space
        stack.append(box)
        self.count += 1

    def full(self) -> int:
        """A new container that is never open."""
        self.opened += 1
        return self.opened

    def place(self, size: int, capacity: int) -> int:
        """The container of an item of size <= capacity."""
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1  # the least free space that holds it
            box = self._take(space)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            space, box = capacity, self.full()
        if space > size:
            self._put(box, space - size)
        return box


def fill(sizes: list[int], capacity: int, most_open: int = OPEN_CONTAINERS) -> list[tuple[int, int, int, int, int, int]]:
    """(index of item, container, piece, pieces, first token, tokens) for a stream of sizes."""
    boxes, out = OpenContainers(most_open), []
    for i, size in enumerate(sizes):
        if size <= capacity:
            out.append((i, boxes.place(size, capacity), 0, 1, 0, size))
            continue
        whole, left = divmod(size, capacity)
        n = whole + (left > 0)
        out.extend((i, boxes.full(), k, n, k * capacity, capacity) for k in range(whole))
        if left:
            out.append((i, boxes.place(left, capacity), whole, n, whole * capacity, left))
    return out


def _stream(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["turn", "item", "tokens"], kind="stable")
    rows = rows.iloc[np.lexsort((rows["item"], -rows["tokens"], np.arange(len(rows)) // WINDOW))]
    capacity = int(rows["capacity"].iloc[0])
    got = pd.DataFrame(fill(rows["tokens"].tolist(), capacity), columns=["at", "box", "piece", "n_pieces", "first_token", "n_tokens"])
    kind, stream = key
    return pd.DataFrame({
        "kind": kind,
        "item": rows["item"].to_numpy()[got["at"].to_numpy()],
        "container": f"{kind}-{stream}-" + got["box"].astype(str),
        "piece": got["piece"],
        "n_pieces": got["n_pieces"],
        "first_token": got["first_token"],
        "n_tokens": got["n_tokens"],
    })


def pack(items: DataFrame, item: str, text: str, kinds: DataFrame, kind: str, capacity: str, stream_items: int = STREAM_ITEMS) -> DataFrame:
    """One row per piece of an item and kind of container: kind, item, container, piece (from 0),
    n_pieces, first_token, n_tokens. Sizes are in tokens of the byte-level tokenizer: UTF-8 bytes.

    An item has one piece unless it exceeds the capacity. Empty and null texts have no tokens and
    one piece of size 0. Rows with a null item are items of their own. A row is packed once for
    every kind; repeated kinds count once, and kinds with a null or no positive capacity hold
    nothing. The result depends only on the rows, not on how they are partitioned.
    """
    spark = items.sparkSession
    kinds = kinds.where(F.col(capacity) > 0).select(F.col(kind).alias("kind"), F.col(capacity).cast("long").alias("capacity")).distinct()
    rows = kinds.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    if not rows:
        return spark.createDataFrame([], PLACED)
    streams = max(1, -(-items.count() // stream_items))
    sized = items.select(F.col(item).cast("long").alias("item"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("tokens"))
    each = F.array(*[F.struct(F.lit(r["kind"]).alias("kind"), F.lit(r["capacity"]).alias("capacity")) for r in rows])
    turn = F.xxhash64("tokens", "item")
    dealt = sized.select("item", "tokens", F.pmod(F.xxhash64("item", "tokens"), F.lit(streams)).alias("stream"), turn.alias("turn"), F.inline(each))
    return dealt.groupBy("kind", "stream").applyInPandas(_stream, PLACED)


def unused(placed: DataFrame, kinds: DataFrame, kind: str, capacity: str) -> DataFrame:
    """kind, containers, tokens, room, unused (share of the room that holds nothing)."""
    boxes = placed.groupBy("kind", "container").agg(F.sum("n_tokens").alias("tokens"))
    total = boxes.groupBy("kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    sizes = kinds.select(F.col(kind).alias("kind"), F.col(capacity).cast("long").alias("capacity")).distinct()
    room = F.col("containers") * F.col("capacity")
    return total.join(sizes, "kind").select("kind", "containers", "tokens", room.alias("room"), (1 - F.col("tokens") / room).alias("unused"))
