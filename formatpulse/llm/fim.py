"""Fill-in-middle: texts cut at two unit boundaries, found by rank in a compressed boundary set.

Units are runs of ASCII letters and single other characters. The ends of a text's units form a set of
places, kept the way compressed bitmaps keep theirs: places are dealt by their high bits into
containers of 2**16 places, and each container takes the smallest of three forms, a sorted array of
low bits, a bitmap, or runs of neighbours. The running sums of the containers' sizes say which one
holds the k-th boundary; a select within it (index, popcount sums, or run-length sums) gives the
place. So a cut after u units costs two binary searches, however long the text.

A text is read one container's width at a time. The order of the parts and whether a text is left as
it is follow from a digest of a seed and the id, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, those left plain, and of a hundred others, those written suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


class ArrayContainer:
    """Low bits in rising order."""

    def __init__(self, member: np.ndarray):
        self.low = np.flatnonzero(member).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit a place, with the sums of ones before each byte."""

    def __init__(self, member: np.ndarray):
        self.bits = np.packbits(member, bitorder="little")

    def select(self, k: int) -> int:
        sums = np.cumsum(_BYTE_ONES[self.bits])
        byte = int(np.searchsorted(sums, k, "right"))
        before = int(sums[byte - 1]) if byte else 0
        ones = np.flatnonzero(np.unpackbits(self.bits[byte:byte + 1], bitorder="little"))
        return byte * 8 + int(ones[k - before])


class RunContainer:
    """Runs of neighbours: first places and lengths."""

    def __init__(self, member: np.ndarray):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], member.view(np.int8), [0]))))
        self.first, self.length = edge[::2].astype(np.uint16), edge[1::2] - edge[::2]

    def select(self, k: int) -> int:
        sums = np.cumsum(self.length)
        run = int(np.searchsorted(sums, k, "right"))
        return int(self.first[run]) + k - (int(sums[run - 1]) if run else 0)


def container(member: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest form: 2 bytes a place, 4 a run, or one bit for every place of the width."""
    places = int(np.count_nonzero(member))
    runs = int(np.count_nonzero(member[1:] & ~member[:-1])) + int(member[0])
    sizes = {ArrayContainer: 2 * places, RunContainer: 4 * runs, BitmapContainer: WIDTH // 8}
    return min(sizes, key=sizes.__getitem__)(member)


class Boundaries:
    """The ends of a text's units, as a set with select."""

    def __init__(self, text: str):
        self.containers, sizes = [], []
        for lo in range(0, len(text), WIDTH):
            # one character more tells whether the last letter ends its run
            points = np.frombuffer(text[lo:lo + WIDTH + 1].encode("utf-32-le", "surrogatepass"), "<u4")
            letter = (points | 32) - np.uint32(97) < 26
            end = np.ones(min(len(text) - lo, WIDTH), bool)
            both = letter[:-1] & letter[1:]
            end[: len(both)] = ~both[: len(end)]
            self.containers.append(container(end))
            sizes.append(int(np.count_nonzero(end)))
        self.sums = np.cumsum(sizes, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.sums[-1]) if len(self.sums) else 0

    def cut(self, units: int) -> int:
        """Characters of the first ``units`` units."""
        if not units:
            return 0
        at = int(np.searchsorted(self.sums, units - 1, "right"))
        local = units - 1 - (int(self.sums[at - 1]) if at else 0)
        return at * WIDTH + self.containers[at].select(local) + 1


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers; a null id stands as an empty one."""
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(name[i:i + 8], 16) for i in range(0, 32, 8)]


def transform_text(text: str | None, doc_id: int | None, seed: int = 1, plain: int = PLAIN,
                   suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix characters, middle characters, output)."""
    text = text or ""
    ends = Boundaries(text)
    n = len(ends)
    a, b, c, d = draws(seed, doc_id)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or c % 100 >= 100 - plain:
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    p, m = ends.cut(low), ends.cut(high)
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    if d % 100 < suffix_first:
        return n, "spm", p, m - p, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", p, m - p, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made from, read from the marks alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, middle = output[len(first):].split(MIDDLE, 1)
    one, other = head.split(second, 1)
    return other + middle + one if form == "spm" else one + middle + other


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST,
                   keep_output: bool = False) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output_sha256,
    restored_sha256, and with ``keep_output`` the output itself.

    Null and empty texts have no unit and are plain, as are texts that hold a mark; a null id draws
    as an empty one; repeated rows give repeated results, and equal ids draw alike; a table without rows gives
    none; further columns are ignored.
    """
    fields = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"

    @F.pandas_udf(fields + (", output string" if keep_output else ""))
    def transformed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for ids, texts in batches:
            rows = []
            for name, text in zip(ids, texts, strict=True):
                n, form, p, m, output = transform_text(text, int(name) if name else None, seed, plain, suffix_first)
                rows.append((n, form, p, m, sha(output), sha(restore(output, form)), *([output] if keep_output else [])))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in fields.split(", ")] + ["output"] * keep_output)
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
    # ids travel as text: a null among them would turn long numbers into fractions
    return docs.select("doc_id", transformed(F.col("doc_id").cast("string"), "text").alias("r")).select("doc_id", "r.*")
