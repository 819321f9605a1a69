"""The command line: run a filter over files, or convert, inspect, validate, merge.

    python -m braidql 'map(select(.age > 30))' people.csv
    python -m braidql convert people.csv people.parquet
"""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import config, sources
from .lang import ParseError, parse
from .operators import basic
from .plans import compile_filter

COMMANDS = ("convert", "inspect", "validate", "merge", "repl", "completions")


def _session(settings: config.Config) -> SparkSession:
    builder = SparkSession.builder.appName("braidql").config("spark.sql.session.timeZone", settings.time_zone).config("spark.ui.showConsoleProgress", "false")
    if settings.master:
        builder = builder.master(settings.master)
    if settings.shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", settings.shuffle_partitions)
    return builder.getOrCreate()


def _reading(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--input-format")
    parser.add_argument("--csv-separator")
    parser.add_argument("--csv-null")
    parser.add_argument("--csv-no-header", action="store_true")
    parser.add_argument("--skip-rows", type=int, default=0)
    parser.add_argument("--columns", type=lambda s: s.split(","))
    parser.add_argument("--ignore-errors", action="store_true")


def _read_options(args: argparse.Namespace) -> dict[str, Any]:
    options: dict[str, Any] = {"format": args.input_format, "skip_rows": args.skip_rows, "columns": args.columns}
    for name, value in (("separator", args.csv_separator), ("null_values", args.csv_null), ("ignore_errors", args.ignore_errors or None)):
        if value is not None:
            options[name] = value
    if args.csv_no_header:
        options["has_header"] = False
    return options


def build_parser() -> tuple[argparse.ArgumentParser, argparse.ArgumentParser]:
    """(parser of a filter run, parser of the commands)."""
    run = argparse.ArgumentParser("braidql", description=__doc__.splitlines()[0])
    run.add_argument("filter", nargs="?", default=".")
    run.add_argument("files", nargs="*")
    run.add_argument("-f", "--filter-file")
    run.add_argument("-o", "--output")
    run.add_argument("--output-format")
    run.add_argument("--config")
    run.add_argument("--limit", type=int)
    run.add_argument("--pretty", action="store_true")
    run.add_argument("--explain", action="store_true")
    run.add_argument("--arg", nargs=2, action="append", default=[], metavar=("NAME", "TEXT"))
    run.add_argument("--argjson", nargs=2, action="append", default=[], metavar=("NAME", "JSON"))
    run.add_argument("--argfile", nargs=2, action="append", default=[], metavar=("NAME", "FILE"))
    _reading(run)
    other = argparse.ArgumentParser("braidql")
    commands = other.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert")
    convert.add_argument("source")
    convert.add_argument("target")
    convert.add_argument("--output-format")
    _reading(convert)
    inspect = commands.add_parser("inspect")
    inspect.add_argument("path")
    inspect.add_argument("--schema", action="store_true")
    inspect.add_argument("--sample", type=int, default=0)
    inspect.add_argument("--stats", action="store_true")
    validate = commands.add_parser("validate")
    validate.add_argument("path")
    validate.add_argument("--schema")
    validate.add_argument("--check-duplicates", action="store_true")
    validate.add_argument("--check-nulls", action="store_true")
    merge = commands.add_parser("merge")
    merge.add_argument("sources", nargs="+")
    merge.add_argument("-o", "--output", required=True)
    merge.add_argument("--method", choices=("concat", "join"), default="concat")
    merge.add_argument("--on", type=lambda s: s.split(","), default=[])
    merge.add_argument("--how", default="inner")
    commands.add_parser("repl")
    commands.add_parser("completions").add_argument("shell", choices=("bash", "zsh", "fish"))
    return run, other


def _show(df: DataFrame, pretty: bool, out) -> None:
    """Results as JSON, row by row, so that the driver holds one partition at a time."""
    if len(df.columns) == 1 and df.columns[0] == "value":
        rows = (json.loads(r)["value"] if "value" in json.loads(r) else None for r in df.toJSON().toLocalIterator())
    else:
        rows = (json.loads(r) for r in df.toJSON().toLocalIterator())
    out.write("[")
    for i, row in enumerate(rows):
        out.write(("," if i else "") + "\n" + json.dumps(row, ensure_ascii=False, indent=2 if pretty else None, default=str))
    out.write("\n]\n")


def run_filter(args: argparse.Namespace, out) -> int:
    settings = config.load(args.config, limit=args.limit, input_format=args.input_format, output_format=args.output_format)
    files = list(args.files)
    text = args.filter
    if args.filter_file:
        files = ([args.filter] if args.filter != "." else []) + files
        with open(args.filter_file) as f:
            text = f.read()
    params = dict(settings.variables) | dict(args.arg)
    params |= {k: json.loads(v) for k, v in args.argjson}
    for name, path in args.argfile:
        with open(path) as f:
            params[name] = json.load(f)
    try:
        parse(text)
    except ParseError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    spark = _session(settings)
    if not files:
        files = [_stdin()]
    df = sources.load(spark, files[0] if len(files) == 1 else files, **_read_options(args))
    result = compile_filter(text, df, params, lambda p: sources.load(spark, p))
    if settings.limit is not None:
        result = result.limit(settings.limit)
    if args.explain:
        result.explain("formatted")
    elif args.output:
        sources.save(result, args.output, args.output_format, mode="overwrite", single=True)
    else:
        _show(result, args.pretty, out)
    return 0


def _stdin() -> str:
    text = sys.stdin.read()
    ending = ".json" if text.lstrip()[:1] in "[{" else ".csv"
    with tempfile.NamedTemporaryFile("w", suffix=ending, delete=False) as f:
        f.write(text)
    return f.name


def completions(shell: str) -> str:
    """What a shell sources to complete commands and options, as the parsers have them."""
    run, other = build_parser()
    flags = lambda p: sorted(o for a in p._actions for o in a.option_strings if o.startswith("--"))
    commands = next(a for a in other._actions if isinstance(a, argparse._SubParsersAction)).choices
    if shell == "fish":
        lines = ["complete -c braidql -n __fish_use_subcommand -a '" + " ".join(commands) + "'"]
        lines += [f"complete -c braidql -n __fish_use_subcommand -l {f[2:]}" for f in flags(run)]
        lines += [f"complete -c braidql -n '__fish_seen_subcommand_from {name}' -l {f[2:]}" for name, p in commands.items() for f in flags(p)]
        return "\n".join(lines) + "\n"
    cases = "\n".join(f'    {name}) words="{" ".join(flags(p))}" ;;' for name, p in commands.items())
    body = f"""_braidql() {{
  local words
  case "${{COMP_WORDS[1]}}" in
{cases}
    *) words="{" ".join([*commands, *flags(run)])}" ;;
  esac
  COMPREPLY=($(compgen -W "$words" -- "${{COMP_WORDS[COMP_CWORD]}}"))
}}
complete -o default -F _braidql braidql
"""
    return body if shell == "bash" else "autoload -U +X bashcompinit && bashcompinit\n" + body


def run_command(args: argparse.Namespace, out) -> int:
    if args.command == "completions":
        out.write(completions(args.shell))
        return 0
    spark = _session(config.load())
    if args.command == "convert":
        sources.convert(spark, args.source, args.target, _read_options(args), {"format": args.output_format, "mode": "overwrite", "single": True})
    elif args.command == "inspect":
        found = sources.inspect(spark, args.path, args.sample, args.stats)
        out.write(json.dumps(found["columns"] if args.schema else found, indent=2, default=str) + "\n")
    elif args.command == "validate":
        schema = None
        if args.schema:
            with open(args.schema) as f:
                schema = json.load(f)
        problems = sources.validate(sources.load(spark, args.path), schema, args.check_duplicates, args.check_nulls)
        out.write("".join(f"{p}\n" for p in problems) or "valid\n")
        return int(bool(problems))
    elif args.command == "merge":
        frames = [sources.load(spark, s) for s in args.sources]
        sources.save(sources.merge(frames, args.method, args.on, args.how), args.output, mode="overwrite", single=True)
    else:
        Repl(spark, out).run(iter(lambda: input("> "), None))
    return 0


class Repl:
    """Lines are filters over the loaded table, or commands with a colon."""

    def __init__(self, spark: SparkSession, out):
        self.spark, self.out, self.df, self.history = spark, out, None, []

    def run(self, lines) -> None:
        try:
            for line in lines:
                if not self.line(line.strip()):
                    return
        except EOFError:
            return

    def line(self, line: str) -> bool:
        if line in (":quit", ":exit", "quit", "exit"):
            return False
        name, _, rest = line.partition(" ")
        try:
            if not line:
                pass
            elif name == ":load":
                self.df = sources.load(self.spark, rest)
            elif name == ":history":
                self.out.write("".join(f"{h}\n" for h in self.history))
            elif name == ":clear":
                self.df = None
            elif name == ":validate":
                parse(rest)
                self.out.write("valid\n")
            elif self.df is None:
                self.out.write("nothing is loaded\n")
            elif name == ":show":
                _show(basic.head(self.df, int(rest or 10)), False, self.out)
            elif name == ":explain":
                compile_filter(rest, self.df).explain("formatted")
            else:
                self.history.append(line)
                _show(compile_filter(line, self.df, load=lambda p: sources.load(self.spark, p)), False, self.out)
        except ValueError as e:
            self.out.write(f"error: {e}\n")
        return True


def main(argv: Sequence[str] | None = None, out=None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    run, other = build_parser()
    out = out or sys.stdout
    if argv[:1] and argv[0] in COMMANDS:
        return run_command(other.parse_args(argv), out)
    return run_filter(run.parse_args(argv), out)
