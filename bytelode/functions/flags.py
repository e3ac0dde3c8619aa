"""Options from the flags of compression commands."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from .options import CodecError, Options


@dataclass
class Command:
    """What a command is to do, beside how it compresses. Inputs are never deleted, so ``keep`` changes nothing."""

    mode: str = "compress"
    paths: list[str] = field(default_factory=list)
    comment: str = ""
    to_stdout: bool = False
    keep: bool = False
    force: bool = False
    recursive: bool = False


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise CodecError(message)


def _parser() -> argparse.ArgumentParser:
    p = _Parser(add_help=False, allow_abbrev=False)
    for level in range(10):
        names = [f"-{level}"] + {1: ["--fast"], 9: ["--best"]}.get(level, [])
        p.add_argument(*names, dest="level", action="store_const", const=level)
    for names, dest, const in (
        (("-d", "--decompress", "--uncompress"), "mode", "decompress"),
        (("-t", "--test"), "mode", "test"),
        (("-l", "--list"), "mode", "list"),
        (("-K", "--zip"), "format", "zip"),
        (("-z", "--zlib"), "format", "zlib"),
        (("-H", "--huffman"), "strategy", "huffman"),
        (("-U", "--rle"), "strategy", "rle"),
        (("-n", "--no-name"), "store_name", False),
        (("-N", "--name"), "store_name", True),
        (("-m", "--no-time"), "store_time", False),
        (("-M", "--time"), "store_time", True),
    ):
        p.add_argument(*names, dest=dest, action="store_const", const=const)
    for names, dest in ((("-c", "--stdout", "--to-stdout"), "to_stdout"), (("-k", "--keep"), "keep"), (("-f", "--force"), "force"), (("-r", "--recursive"), "recursive"), (("-i", "--independent"), "independent"), (("-R", "--rsyncable"), "rsyncable")):
        p.add_argument(*names, dest=dest, action="store_true")
    # taken and without effect here: tuning of an exhaustive search, syncing, and how much is said
    for names in (("-F", "--first"), ("-O", "--oneblock"), ("-Y", "--synchronous"), ("-q", "--quiet", "--silent"), ("-v", "--verbose"), ("-h", "--help"), ("-L", "--license"), ("-V", "--version")):
        p.add_argument(*names, dest="ignored", action="store_true")
    for names in (("-I", "--iterations"), ("-J", "--maxsplits")):
        p.add_argument(*names, dest="ignored", type=int)
    p.add_argument("-b", "--blocksize", type=int)
    p.add_argument("-p", "--processes", type=int)
    p.add_argument("-C", "--comment", default="")
    p.add_argument("-S", "--suffix")
    p.add_argument("-A", "--alias", default="-")
    p.add_argument("-E", "--engine", default="auto")
    p.add_argument("paths", nargs="*")
    return p


def parse(args: list[str]) -> tuple[Options, Command]:
    """The options and the command of flags and paths, like ``["-9", "-i", "a.txt"]``; what isn't known is an error."""
    end = args.index("--") if "--" in args else len(args)
    flags, rest = args[:end], args[end + 1 :]
    deepest = [a for a in flags if a.startswith("-") and a[1:].isdigit() and len(a) > 2]
    if any(a != "-11" for a in deepest):
        raise CodecError(f"no level {deepest[0][1:]}")
    n = _parser().parse_args([a for a in flags if a not in deepest])
    if n.processes is not None and n.processes < 1:
        raise CodecError("a process at least")
    form = n.format or "gzip"
    given = {"level": 11 if deepest else n.level, "strategy": n.strategy, "store_name": n.store_name, "store_time": n.store_time, "threads": n.processes, "block_size": None if n.blocksize is None else n.blocksize << 10}
    suffix = n.suffix or {"gzip": ".gz", "zlib": ".zz", "zip": ".zip"}[form]
    opts = Options(format=form, engine=n.engine, independent=n.independent, rsyncable=n.rsyncable, alias=n.alias, suffix=suffix, **{k: v for k, v in given.items() if v is not None})
    return opts, Command(n.mode or "compress", n.paths + rest, n.comment, n.to_stdout, n.keep, n.force, n.recursive)
