"""Options of the codecs, checked where they are made."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

WINDOW = 32_768
MIN_BLOCK, DEFAULT_BLOCK = 32_768, 131_072
PARALLEL_FROM = 1 << 20
FORMATS = ("gzip", "zlib", "zip", "raw")
STRATEGIES = {"default": zlib.Z_DEFAULT_STRATEGY, "filtered": zlib.Z_FILTERED, "huffman": zlib.Z_HUFFMAN_ONLY, "huffman-only": zlib.Z_HUFFMAN_ONLY, "rle": zlib.Z_RLE, "fixed": zlib.Z_FIXED}
ENGINES = {"auto": "zlib", "zlib": "zlib", "zlib-ng": "zlib", "zlibng": "zlib", "isal": "zlib", "isa-l": "zlib"}


class CodecError(ValueError):
    """A stream, archive or image that can't be read, or an option that isn't one."""


@dataclass(frozen=True)
class Options:
    """How to compress. Level -1 means 6, level 11 tries several ways and keeps the smallest."""

    level: int = -1
    strategy: str = "default"
    engine: str = "auto"
    format: str = "gzip"
    block_size: int = DEFAULT_BLOCK
    independent: bool = False
    rsyncable: bool = False
    threads: int = 0
    store_name: bool = True
    store_time: bool = True
    suffix: str = ".gz"
    alias: str = "-"
    min_block: int = MIN_BLOCK

    def __post_init__(self) -> None:
        if self.level not in (*range(-1, 10), 11):
            raise CodecError(f"level {self.level}: -1 to 9, or 11")
        if self.strategy not in STRATEGIES:
            raise CodecError(f"unknown strategy {self.strategy!r}")
        if self.engine not in ENGINES:
            raise CodecError(f"unknown engine {self.engine!r}")
        if self.format not in FORMATS:
            raise CodecError(f"unknown format {self.format!r}")
        if self.block_size < self.min_block:
            raise CodecError(f"a block has at least {self.min_block} bytes")
        if self.threads < 0:
            raise CodecError("threads can't be negative")

    @property
    def zlib_level(self) -> int:
        return 6 if self.level == -1 else min(self.level, 9)

    @property
    def zlib_strategy(self) -> int:
        return STRATEGIES[self.strategy]

    @property
    def engine_used(self) -> str:
        return ENGINES[self.engine]


def adaptive_block(size: int, threads: int, largest: int = 2 << 20) -> int:
    """The block size for a blob: halved from the largest while there are fewer than four blocks a thread."""
    block = largest
    while block > DEFAULT_BLOCK and size // block < 4 * max(1, threads):
        block //= 2
    return block


def thread_cap(size: int, block: int, threads: int) -> int:
    """As many threads as have two blocks each."""
    return min(max(1, threads), max(1, size // (2 * block)))


def fast_level(level: int) -> int:
    """The level of a four-level engine, for reports."""
    return 0 if level <= 0 else 1 if level <= 2 else 2 if level <= 4 else 3
