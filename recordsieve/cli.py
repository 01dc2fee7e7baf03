"""Command line: python -m recordsieve.cli [options] selector... [file...]"""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import SparkSession

from .engine import VERSION, Engine
from .lang.errors import SieveError
from .sources import ndjson


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recordsieve", description="Select, reshape and change newline-delimited JSON records.")
    p.add_argument("-m", "--mutate", action="append", default=[], help="apply mutations to matching records")
    p.add_argument("-f", "--field", action="append", default=[], help="output only these paths")
    p.add_argument("-i", "--inline", "-w", "--write", action="store_true", help="write the output over the one input file")
    p.add_argument("-F", "--enable-file-mutations", action="store_true", help="allow file:, textfile: and base64file: values")
    p.add_argument("-c", "--compact", action="store_true", help="compact output, as always")
    p.add_argument("-t", "--theme", help="not supported")
    p.add_argument("-O", "--or", dest="any_of", action="store_true", help="one of the selectors is enough")
    p.add_argument("-M", "--matches-only", action="store_true", help="only matching records, also with -m")
    p.add_argument("--count", action="store_true", help="only the number of matches")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    p.add_argument("words", nargs="*", help="selectors, then input files")
    return p


def _inputs(words: list[str], mutating: bool) -> tuple[list[str], list[str]]:
    """(selectors, files): with mutations every existing file is input, else the last word if it is one."""
    if mutating:
        return [w for w in words if not ndjson.is_regular(w)], [w for w in words if ndjson.is_regular(w)]
    if words and ndjson.is_regular(words[-1]):
        return words[:-1], words[-1:]
    return words, []


#: The spellings of true and false that flags take.
_TRUE, _FALSE = ("true", "True", "TRUE", "t", "T", "1"), ("false", "False", "FALSE", "f", "F", "0")
_FLAG = re.compile(r"(--(?:inline|write|enable-file-mutations|compact|or|matches-only|count)|-[iwFcOM])=(.*)", re.S)


def _flags(argv: list[str]) -> list[str]:
    """Flags with a truth value, as --or=false, spelled as bare flags or left out; the last of a flag holds."""
    out: list[str] = []
    for word in argv:
        found = _FLAG.fullmatch(word)
        if not found:
            out.append(word)
            continue
        if found[2] not in (*_TRUE, *_FALSE):
            raise SieveError(f"no truth value: {word}")
        out = [w for w in out if w != found[1]] + [found[1]] * (found[2] in _TRUE)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    try:
        a = parser().parse_args(_flags(sys.argv[1:] if argv is None else argv))
    except SieveError as e:
        print(f"recordsieve: {e}", file=sys.stderr)
        return 1
    out = out or sys.stdout
    try:
        if a.theme:
            raise SieveError("themes are not supported")
        if a.inline and a.count:
            raise SieveError("a count is not written inline")
        words, files = _inputs(a.words, bool(a.mutate))
        if a.inline and len(files) != 1:
            raise SieveError("inline output needs one input file")
        spark = spark or SparkSession.builder.appName("recordsieve").config("spark.ui.enabled", "false").getOrCreate()
        engine = Engine(spark)
        request = engine.request((",\n" if a.any_of else "\n").join(words), a.field, a.mutate, any_of=a.any_of, matched_only=a.matches_only or not a.mutate, files=a.enable_file_mutations)
        if a.inline:
            engine.rewrite_file(files[0], request)
            return 0
        temp = None if files else ndjson.spooled(spark, sys.stdin.buffer)
        try:
            if a.count:
                out.write(f"{engine.count(files or [temp], request)}\n")
                return 0
            seen = 0
            for path in files or [temp]:
                rows, result = engine.run(path, request)
                seen += result.seen
                for line in ndjson.ordered(rows):
                    out.write(line + "\n")
            if a.mutate and not seen:
                raise SieveError("no records to change")
        finally:
            if temp:
                ndjson.delete(spark, temp)
    except SieveError as e:
        print(f"recordsieve: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
