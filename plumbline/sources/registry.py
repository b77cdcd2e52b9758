"""Readers by name: which may open a file, and opening it with the first that can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HEAD_BYTES = 2048


class NotThisFormat(Exception):
    """A reader's way to pass a file on to the next one."""


@dataclass(frozen=True)
class Options:
    """What to read: a variable, a box (west, south, east, north) and a period."""

    var: str | None = None
    bbox: tuple[float, float, float, float] | None = None
    start: str | None = None
    end: str | None = None
    lang: str = "en"


@dataclass
class Dataset:
    """What a reader found: its kind, rows and facts about the file."""

    kind: str
    df: DataFrame | None
    meta: dict = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)
    reader: str = ""


@dataclass(frozen=True)
class Reader:
    name: str
    category: str
    read: Callable[[SparkSession, Path, Options], Dataset]
    extensions: tuple[str, ...] = ()
    magic: tuple[bytes, ...] = ()
    sniff: Callable[[bytes], bool] | None = None
    requires: tuple[str, ...] = ()
    hint: str = ""
    priority: int = 10

    def signed(self, head: bytes) -> bool:
        return any(head.startswith(m) for m in self.magic) or bool(self.sniff and self.sniff(head))


READERS: dict[str, Reader] = {}


def reader(name: str, category: str, **options):
    """Register a function (spark, path, options) -> Dataset under a name."""

    def register(f):
        READERS[name] = Reader(name, category, f, **options)
        return f

    return register


def missing_library(name: str, category: str, module: str, **options) -> None:
    """Register a format whose library isn't installed: files of it name what to install."""

    def read(spark, path, opts):
        raise NotThisFormat(f"install {module} to read {name}")

    READERS[name] = Reader(name, category, read, requires=(module,), hint=f"install {module} to read {name} files", **options)


def suffixes(path: Path) -> list[str]:
    """Compound endings, the longest first: a.tar.gz has .tar.gz and .gz."""
    parts = path.name.lower().split(".")[1:]
    return ["." + ".".join(parts[i:]) for i in range(len(parts))]


def candidates(path: Path, head: bytes) -> list[Reader]:
    """Readers to try, best first: ending that no signature contradicts, then signature, then ending alone."""
    ranked = sorted(READERS.values(), key=lambda r: r.priority)
    ends = suffixes(path)
    by_end = sorted((r for r in ranked if set(ends) & set(r.extensions)), key=lambda r: min(ends.index(e) for e in r.extensions if e in ends))
    first = [r for r in by_end if not (r.magic or r.sniff) or r.signed(head)]
    second = [r for r in ranked if (r.magic or r.sniff) and r.signed(head)]
    return list(dict.fromkeys([*first, *second, *by_end]))


def read(spark: SparkSession, path: str | Path, options: Options | None = None) -> Dataset:
    """Open a file with the first reader that can; failures become ``problems``; the last resort is ``unknown``."""
    from plumbline.sources import arrays, documents, images, rasters, tabular, unknown, workbooks  # noqa: F401

    path, options, problems = Path(path), options or Options(), []
    head = b""
    if path.is_file():
        with open(path, "rb") as f:
            head = f.read(HEAD_BYTES)
    for r in candidates(path, head):
        lacking = [m for m in r.requires if find_spec(m) is None]
        if lacking:
            problems.append(r.hint or f"{r.name}: install {', '.join(lacking)}")
            continue
        try:
            got = r.read(spark, path, options)
        except NotThisFormat as e:
            problems.append(f"{r.name}: {e}")
            continue
        except Exception as e:  # noqa: BLE001  any failure of a format becomes a row of the report
            problems.append(f"{r.name}: {type(e).__name__}: {e}")
            if any(head.startswith(m) for m in r.magic):
                break
            continue
        got.reader, got.problems = r.name, problems
        return got
    got = unknown.read_unknown(spark, path, options)
    got.reader, got.problems = "unknown", problems
    return got


def looks_like_text(head: bytes) -> bool:
    """No zero bytes, few control bytes, and UTF-8 but for a cut end, or Latin-1."""
    if b"\0" in head:
        return False
    if sum(b < 32 and not 9 <= b <= 13 for b in head) > 0.01 * max(1, len(head)):
        return False
    return True


def decoded(head: bytes) -> str:
    for cut in range(4):
        try:
            return head[: len(head) - cut].decode("utf-8")
        except UnicodeDecodeError:
            continue
    return head.decode("latin-1")
