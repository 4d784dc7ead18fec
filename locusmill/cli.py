"""Command line: python -m locusmill.cli TOOL INPUT... ; exit 2 means the input's shape rules a result out."""

from __future__ import annotations

import argparse
import dataclasses
import sys
import typing

from pyspark.sql import SparkSession

from . import api
from .operators import fragments, peaks, profile, reads
from .sources import sinks, text

VERSION = "0.2.0"
#: What each tool runs, its further inputs and its options.
TOOLS = {
    "qc": (api.run_qc, [], None),
    "trim": (api.trim, [], reads.TrimOptions),
    "sizes": (api.fragment_sizes, [], fragments.FragmentFilter),
    "markdup": (api.mark_duplicates, [], None),
    "frip": (api.frip, ["peaks"], None),
    "peaks": (api.call_peaks, ["contigs"], peaks.PeakOptions),
    "profile": (api.profile, ["alignments", "contigs"], profile.ProfileOptions),
}
TERMS = {
    "contig": "a sequence that positions refer to; lengths come from a two-column file",
    "fragment": "the stretch a read pair covers, half open, counted from 0",
    "fraction in peaks": "fragments that share a base with a merged peak, over all fragments",
    "island": "scored bases at most max_gap apart",
    "q value": "step-up adjusted score over all candidates, as -log10",
}


def _region(value: str) -> tuple[str, int, int]:
    contig, _, place = value.rpartition(":")
    first, _, last = place.replace(",", "").partition("-")
    if not contig or not first.isdigit() or not last.isdigit():
        raise argparse.ArgumentTypeError("a region is written contig:start-stop, counted from 1")
    return contig, int(first) - 1, int(last)


def _options(parser: argparse.ArgumentParser, kind: type) -> None:
    hints = typing.get_type_hints(kind)
    for f in dataclasses.fields(kind):
        name = "--" + f.name.replace("_", "-")
        if hints[f.name] is bool:
            parser.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        elif f.name == "adapters":
            parser.add_argument("--adapter", action="append", default=[], help="an adapter to cut; repeatable")
            parser.add_argument("--default-adapters", action="store_true", help="cut the common adapters")
        else:
            parser.add_argument(name, type=type(f.default), default=f.default, choices=typing.get_args(hints[f.name]) or None)


def _chosen(a: argparse.Namespace, kind: type):
    found = kind(**{f.name: getattr(a, f.name) for f in dataclasses.fields(kind) if f.name != "adapters"})
    if kind is reads.TrimOptions and (a.adapter or a.default_adapters):
        more = tuple(x.upper() for x in a.adapter) + (reads.DEFAULT_ADAPTERS if a.default_adapters else ())
        found = found.with_adapters(*more)
    return found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusmill")
    sub = p.add_subparsers(dest="tool", required=True)
    sub.add_parser("versions", help="versions of this library and of Spark")
    sub.add_parser("man", help="what the tools do and what words mean").add_argument("topic", nargs="?", choices=sorted(TOOLS))
    for tool, (run, more, options) in TOOLS.items():
        s = sub.add_parser(tool, help=run.__doc__, description=run.__doc__)
        s.add_argument("input")
        for m in more:
            s.add_argument(m)
        if options:
            _options(s, options)
        if tool in ("sizes", "markdup", "frip"):
            s.add_argument("--with-counts", action="store_true", help="column 5 of a BED file is a copy count")
        if tool in ("sizes", "frip"):
            s.add_argument("--region", action="append", type=_region, default=[], help="contig:start-stop; repeatable")
        if tool == "frip":
            s.add_argument("--genome", type=int, required=True)
            s.add_argument("--keep-duplicates", action="store_true")
        if tool == "profile":
            s.add_argument("--norm", choices=typing.get_args(profile.Norm), default="raw")
            s.add_argument("--profile-out")
        if tool in ("qc", "trim"):
            s.add_argument("--text", action="store_true", help="the report as lines instead of JSON")
        s.add_argument("--out")
    return p


def manual(topic: str | None) -> str:
    if topic:
        return f"{topic}: {TOOLS[topic][0].__doc__}"
    lines = [f"{name:8} {' '.join((run.__doc__ or '').split())}" for name, (run, _, _) in TOOLS.items()]
    return "\n".join([*lines, "", *(f"{k}: {v}" for k, v in TERMS.items())])


def _run(spark: SparkSession, a: argparse.Namespace) -> api.Result:
    options = _chosen(a, TOOLS[a.tool][2]) if TOOLS[a.tool][2] else None
    if a.tool == "qc":
        return api.run_qc(spark, a.input)
    if a.tool == "trim":
        return api.trim(spark, a.input, options)
    if a.tool == "sizes":
        return api.fragment_sizes(spark, a.input, options, a.with_counts, a.region)
    if a.tool == "markdup":
        return api.mark_duplicates(spark, a.input, with_counts=a.with_counts)
    if a.tool == "frip":
        return api.frip(spark, a.input, a.peaks, a.genome, a.keep_duplicates, a.with_counts, a.region)
    if a.tool == "peaks":
        return api.call_peaks(spark, a.input, a.contigs, options)
    return api.profile(spark, a.input, a.alignments, text.chrom_sizes(spark, a.contigs), options, a.norm)


_SINKS = {
    "trim": ("reads", sinks.write_fastq),
    "sizes": ("histogram", sinks.write_histogram),
    "peaks": ("peaks", sinks.write_narrow_peak),
    "profile": ("matrix", sinks.write_matrix),
}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.tool == "versions":
        import pyspark

        print(sinks.report_json({"locusmill": VERSION, "pyspark": pyspark.__version__}))
        return 0
    if a.tool == "man":
        print(manual(a.topic))
        return 0
    spark = SparkSession.builder.getOrCreate()
    try:
        if a.out:
            sinks.refuse_alias(a.input, a.out)
        r = _run(spark, a)
        if a.out and a.tool in _SINKS:
            frame, write = _SINKS[a.tool]
            write(r.frames[frame], a.out)
        if a.tool == "profile" and a.profile_out:
            sinks.write_profile(r.frames["profile"], a.profile_out)
    except text.InvalidInput as e:
        print(sinks.report_json({"error": str(e), "result": e.result}))
        return 2
    except (ValueError, OSError, api.ToolError) as e:
        print(e, file=sys.stderr)
        return 1
    if getattr(a, "text", False):
        print(sinks.report_text(f"locusmill {VERSION} {a.tool}", a.input, r.metrics, r.wall_seconds), end="")
    else:
        print(sinks.report_json({"tool": r.tool, "wall_seconds": round(r.wall_seconds, 3)} | r.metrics))
    return 0


if __name__ == "__main__":
    sys.exit(main())
