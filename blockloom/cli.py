"""Command line: python -m blockloom.cli [options] file... on a local or given Spark master."""

from __future__ import annotations

import argparse
import os
import shlex
import sys

OK, FATAL, WARNED = 0, 1, 4


VERSION = "blockloom 0.2: block compression on Spark"


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        print(f'blockloom: {message}, specify "-h" for help', file=sys.stderr)
        raise SystemExit(FATAL)


class _Out(argparse.Action):
    """-c and -t exclude each other; -t decompresses, a later -d or -z takes it back."""

    def __call__(self, parser, o, values, option_string=None):
        out = self.const
        if {o.out, out} == {"c", "t"}:
            parser.error('"-c" and "-t" are incompatible')
        o.out, o.mode = out, "d" if out == "t" else o.mode


class _Mode(argparse.Action):
    def __call__(self, parser, o, values, option_string=None):
        o.mode, o.out = self.const, None if o.out == "t" else o.out


def _workers(value: str) -> int:
    if not value.isdigit() or not 1 <= int(value) <= 1 << 16:
        raise argparse.ArgumentTypeError(f'"{value}" is no number of workers')
    return int(value)


def parser(name: str = "") -> argparse.ArgumentParser:
    """Options; the name that the program is called by gives the mode: bunzip2 and bzcat decompress, the latter to standard output."""
    p = _Parser(prog="blockloom")
    p.add_argument("files", nargs="*")
    p.add_argument("-n", type=_workers, default=None, help="workers")
    for i in range(1, 10):
        p.add_argument(f"-{i}", dest="level", action="store_const", const=i)
    p.add_argument("--fast", dest="level", action="store_const", const=1)
    p.add_argument("--best", dest="level", action="store_const", const=9)
    p.add_argument("-d", "--decompress", dest="mode", nargs=0, action=_Mode, const="d")
    p.add_argument("-z", "--compress", dest="mode", nargs=0, action=_Mode, const="z")
    p.add_argument("-t", "--test", dest="out", nargs=0, action=_Out, const="t")
    p.add_argument("-c", "--stdout", dest="out", nargs=0, action=_Out, const="c")
    p.add_argument("-k", "--keep", action="store_true")
    p.add_argument("-f", "--force", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-u", "--sequential", action="store_true")
    p.add_argument("-V", "--version", "-L", "--license", action="version", version=VERSION)
    for ignored in (("-q", "--quiet"), ("--repetitive-fast",), ("--repetitive-best",), ("--exponential",), ("-s", "--small"), ("-S",)):
        p.add_argument(*ignored, action="store_true", help=argparse.SUPPRESS)
    p.add_argument("-m", help=argparse.SUPPRESS)
    p.set_defaults(level=9, mode="d" if name in ("bunzip2", "bzcat") else "z", out="c" if name == "bzcat" else None)
    return p


def _filter(spark, o) -> int:
    """Standard input to standard output; nothing compressed goes to or comes from a terminal."""
    from blockloom.operators import streams

    data = sys.stdin.buffer.read()
    files = spark.createDataFrame([("-", data)], "file_id string, content binary")
    if o.out == "t":
        bad = streams.verify(files).where("status <> 0").collect()
        for r in bad:
            print(f"blockloom: (stdin): {r.message}", file=sys.stderr)
        return FATAL if bad else OK
    if o.mode == "z":
        rows = streams.compress(files, o.level, "sequential" if o.sequential else "parallel").selectExpr("content AS data", "0 AS status")
    else:
        rows = (streams.pass_through(files) if o.force else streams.decompress(files)).orderBy("part").select("data", "status")
    for r in rows.toLocalIterator():
        if r.status:
            print("blockloom: (stdin): cannot be decompressed", file=sys.stderr)
            return FATAL
        sys.stdout.buffer.write(bytes(r.data))
    sys.stdout.buffer.flush()
    return OK


class _Failed(Exception):
    pass


def _create(name: str, force: bool) -> None:
    """A new file that only its owner may read until it is whole; one that exists is taken away first under -f, else refused."""
    try:
        if force and os.path.lexists(name):
            os.unlink(name)
        os.close(os.open(name, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600))
    except FileExistsError:
        raise _Failed(f'"{name}" exists') from None


def main(argv: list[str] | None = None, name: str | None = None) -> int:
    """Status 0, 1 after a fatal error, 4 where something was skipped."""
    given = [w for v in ("BZIP2", "BZIP") for w in shlex.split(os.environ.get(v, ""))]
    called = os.path.basename(sys.argv[0]) if name is None else name
    try:
        o = parser(called).parse_args(given + (sys.argv[1:] if argv is None else argv))
        if not o.files and o.mode == "d" and sys.stdin.isatty():
            parser().error("won't read compressed data from a terminal")
        if o.mode == "z" and (o.out == "c" or not o.files) and sys.stdout.isatty():
            parser().error("won't write compressed data to a terminal")
    except SystemExit as e:
        return int(e.code or 0)
    o.stdout, o.test = o.out == "c", o.out == "t"
    o.keep = o.keep or o.stdout or o.test
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from blockloom.functions import expressions as E
    from blockloom.operators import streams

    spark = SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{o.n or '*'}]")).config("spark.ui.enabled", "false").getOrCreate()
    if not o.files:
        return _filter(spark, o)
    state = OK
    names = []
    for f in o.files:
        why = None
        if not os.path.exists(f):
            why = "no such file"
        elif not o.force and not o.stdout and not o.test and not os.path.isfile(f):
            why = "not a regular file"
        elif not o.force and not o.keep and not o.stdout and not o.test and os.stat(f).st_nlink > 1:
            why = "more than one links"
        elif o.mode == "z" and f.endswith((".bz2", ".tbz2", ".tbz", ".tz2")):
            why = "compressed suffix"
        if why:
            print(f'blockloom: skipping "{f}": {why}', file=sys.stderr)
            state = WARNED
        else:
            names.append(f)
    if not names:
        return state
    table = spark.read.format("binaryFile").load([f"file://{os.path.abspath(f)}" for f in names])
    files = table.select(F.regexp_replace("path", "^file:/*", "/").alias("file_id"), "content")
    made: dict[str, list] = {}
    if o.test:
        for r in streams.verify(files).where("status <> 0").toLocalIterator():
            print(f'blockloom: "{r.file_id}": {r.message}', file=sys.stderr)
            return FATAL
        return state
    if o.mode == "z":
        out = streams.compress(files, o.level, "sequential" if o.sequential else "parallel").select("file_id", F.concat("file_id", F.lit(".bz2")).alias("name"), F.lit(0).alias("part"), "content", F.lit(0).alias("status"))
    else:
        parts = streams.pass_through(files) if o.stdout and o.force else streams.decompress(files)
        out = parts.select("file_id", E.output_name(F.col("file_id")).alias("name"), "part", F.col("data").alias("content"), "status")
    try:
        for r in out.orderBy("file_id", "part").toLocalIterator():
            if r.status:
                raise _Failed(f'"{r.file_id}": cannot be decompressed')
            if o.stdout:
                sys.stdout.buffer.write(bytes(r.content))
                continue
            if r.name not in made:
                _create(r.name, o.force)
                made[r.name] = [r.file_id, 0]
            with open(r.name, "ab") as f:
                f.write(bytes(r.content))
            made[r.name][1] += len(r.content)
    except BaseException as e:
        # files before this one are whole and stay; if the job itself failed, the last one may not be
        for n in [n for n in list(made)[-1:] if not isinstance(e, _Failed) or made[n][0] == r.file_id]:
            os.unlink(n)
            del made[n]
        if not isinstance(e, _Failed):
            raise
        print(f"blockloom: {e}", file=sys.stderr)
        state = FATAL
    for name, (source, n) in made.items():
        st = os.stat(source)
        os.chmod(name, st.st_mode & 0o777)
        os.utime(name, ns=(st.st_atime_ns, st.st_mtime_ns))
        if o.verbose and n and st.st_size:
            packed, plain = (n, st.st_size) if o.mode == "z" else (st.st_size, n)
            print(f"blockloom: {source}: {packed / plain:.3f}, space savings {100 * (1 - packed / plain):.2f}%", file=sys.stderr)
        if not o.keep:
            os.unlink(source)
    return state


if __name__ == "__main__":
    sys.exit(main())
