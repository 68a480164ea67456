"""Command line: ``python -m beaconry VERB ...``. Exit 0 fine, 1 failure or findings, 2 usage."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .functions import codecs, text, wire
from .functions.schema import TelemetryError
from .operators import compare, ranking, redact, stats, timeline, validate
from .plans import dsl
from .sources import corpus, readers, writers


#: Bytes of a key's seed at most.
MOST_SEED = 4096


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("beaconry").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="beaconry")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **options):
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a, nargs="+" if a == "paths" else None)
        for o, how in options.items():
            v.add_argument(f"--{o.replace('_', '-')}", **how)

    hexed = {"type": bytes.fromhex, "default": None, "help": "the key, in hex"}
    seeded = {"type": str.encode, "default": None, "help": "derive the key from this text"}
    for name in ("decode", "dump", "stats", "index", "validate"):
        verb(name, "path")
    verb("verify", "path", key=hexed, seed=seeded)
    verb("query", "expr", "path")
    verb("select", "expr", "path", "out")
    verb("export", "path", "format")
    for name in ("import", "import-json", "dedup"):
        verb(name, "path", "out")
    verb("diff", "path", "other", max_report={"type": int, "default": 0}, ignore_redaction={"action": "store_true"})
    verb("merge", "out", "paths")
    verb("split", "path", "out", prefix={"default": "split"})
    verb("repack", "path", "out", "codec")
    verb("timeline", "path", expected={"type": int, "default": 0}, tolerance={"type": int, "default": 0})
    verb("topk", "path", "field", n={"type": int, "default": 10})
    verb("sample", "path", "out", n={"type": int, "default": 0}, seed={"type": int, "default": 0})
    verb("sign", "path", "out", key=hexed, seed=seeded)
    verb("make-key", "seed", hex={"action": "store_true"})
    verb("generate", "seed", "out")
    return p


def _show(lines) -> None:
    for line in lines:
        print(line)


def _lines(rows: DataFrame) -> list[str]:
    return [r["line"] for r in rows.orderBy("record_index").collect()]


def _stats_lines(scan: readers.Scan) -> list[str]:
    total = stats.totals(scan.records, scan.errors).first()
    out = [f"records: {total['records']}"] + ([f"parse-errors: {total['parse_errors']}"] if total["parse_errors"] else [])
    out += ["by-type:"] + [f"  {r['type']:<10s} {r['records']}" for r in stats.by_type(scan.records).orderBy("tag").collect()]
    out += ["numeric:"] + [f"  {r['label']:<20s} n={r['n']} min={r['min']:.3f} max={r['max']:.3f} avg={r['avg']:.3f}" for r in stats.numeric(scan.records).collect()]
    levels = stats.severities(scan.records).orderBy("severity").collect()
    return out + (["log-severity:"] if levels else []) + [f"  {r['severity']:<3d} {r['records']}" for r in levels]


def run(a: argparse.Namespace, spark: SparkSession) -> int:
    read = lambda path=None, mode="permissive": readers.read_dtl(spark, path or a.path, mode, keep=True)
    records = lambda: _whole(read())
    v = a.verb
    if v in ("decode", "query"):
        if v == "query":
            dsl.parse(a.expr)  # a bad expression wins over a missing file
        scan = read(mode="stop")
        rows = redact.redact_keystore(scan.records)
        _show(_lines(writers.printed_lines(rows.filter(dsl.predicate(a.expr)) if v == "query" else rows)))
        fault = scan.errors.first()
        if fault:  # what came before it is printed
            raise TelemetryError(fault["error"])
    elif v == "dump":
        h = readers.read_headers(spark, a.path).first()
        s = readers.read_sections(spark, a.path).orderBy("section_index").collect()
        print(f"version={h['version']} flags=0x{h['flags']:02x} sections={h['sections']} hmac={'yes' if h['has_mac'] else 'no'}")
        _show(f"section {r['section_index']}: type={r['section_type']} codec={r['codec_id']} raw={r['raw_len']} comp={r['comp_len']} offset={r['offset']}" for r in s)
    elif v == "verify":
        verdict = readers.verify(spark, a.path, _key(a)).first()["verdict"]
        print(f"verify: {verdict}")
        return 0 if verdict in ("OK", "no-hmac") else 1
    elif v == "stats":
        _show(_stats_lines(read()))
    elif v == "index":
        _show(f"{r['type']:<10s} {r['records']}" for r in stats.by_type(records()).orderBy("tag").collect())
    elif v == "validate":
        scan = read()
        lines = validate.report(scan.records, scan.errors)
        _show(lines)
        return int(lines[-1].endswith("FAIL"))
    elif v == "export":
        form = text.parse_format(a.format)
        print(writers.document((writers.csv_lines if form == "csv" else writers.json_lines)(records()), form), end="")
    elif v in ("import", "import-json"):
        _write(a, (readers.read_csv if v == "import" else readers.read_json)(spark, a.path))
    elif v == "diff":
        left, right = (_whole(read(x)) for x in (a.path, a.other))
        d = compare.diff(left, right, a.ignore_redaction, left_name=a.path, right_name=a.other)
        lines = compare.report(d, a.max_report)
        _show(lines)
        return int(bool(lines))
    elif v == "merge":
        m = writers.merged([_whole(read(x)) for x in a.paths])
        _write(a, m, order=("input_ord", "record_index"))
    elif v == "split":
        writers.write_files(writers.containers(writers.split(records(), a.prefix), order=("record_index",)), a.out)
    elif v == "repack":
        ids = {name: i for i, name in codecs.CODECS.items()}
        _write(a, records(), codec=ids.get(a.codec, int(a.codec) if a.codec.isdigit() else -1))
    elif v == "select":
        kept = dsl.select(records(), a.expr)
        _write(a, kept)
        print(f"select: kept {kept.count()}")
    elif v == "timeline":
        _show(timeline.report(records(), a.expected, a.tolerance))
    elif v == "topk":
        found = ranking.candidates(records(), a.field)
        print(f"topk {a.field}: {found.count()} candidates")
        _show(f"  record {r['record_index']} {r['value']:.3f}" for r in ranking.topk(records(), a.field, a.n).collect())
    elif v == "dedup":
        print(f"dedup: dropped {compare.dropped(records()).first()[0]}")
        _write(a, compare.dedup(records()))
    elif v == "sample":
        taken = ranking.sample(records(), a.n, a.seed)
        _write(a, taken)
        print(f"sample: took {taken.count()}")
    elif v == "sign":
        key = _key(a)
        if key is None:
            raise TelemetryError("INVAL", "a key or a seed is needed")
        _write(a, records(), key=key)
    elif v == "make-key":
        seed = bytes.fromhex(a.seed) if a.hex else a.seed.encode()
        if not 0 < len(seed) <= MOST_SEED:
            raise TelemetryError("INVAL", "seed")
        print(wire.derive_key(seed).hex())
    elif v == "generate":
        n = int(a.seed) % (1 << 32)
        folder, name = _place(a.out)
        writers.write_files(corpus.generate(spark, n, 1, name), folder)
        print(f"generate: wrote {a.out} ({len(corpus.corpus_container(n))} bytes, seed={n})")
    return 0


def _whole(scan: readers.Scan) -> DataFrame:
    """The records, unless the container as a whole was rejected."""
    rejected = scan.errors.filter("section_index IS NULL").first()
    if rejected:
        raise TelemetryError(rejected["error"])
    return scan.records


def _key(a) -> bytes | None:
    return a.key if a.seed is None else wire.derive_key(a.seed)


def _place(out: str) -> tuple[str, str]:
    """Folder and name of an output file."""
    folder, name = out.rsplit("/", 1) if "/" in out else (".", out)
    return folder if "://" in folder else os.path.abspath(folder), name


def _write(a, records: DataFrame, **how) -> None:
    """All records as the one container that ``out`` names."""
    folder, name = _place(a.out)
    made = writers.containers(records.withColumn("path", F.lit(name)), **how)
    if not writers.write_files(made, folder):  # no records: a container without sections
        empty = records.sparkSession.createDataFrame([(name, wire.build_container([], how.get("key")))], "path string, content binary")
        writers.write_files(empty, folder)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        return run(a, _session())
    except TelemetryError as e:
        print(f"beaconry: {e}", file=sys.stderr)
    except Exception as e:  # Spark wraps what a task or the file listing raises
        print(f"beaconry: {str(e).strip().splitlines()[-1] if str(e).strip() else e!r}", file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main())
