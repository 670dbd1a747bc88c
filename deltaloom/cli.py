"""Command line: check, context, review, index, doctor, models, init."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from deltaloom.operators.staging import clear, stage
from deltaloom.plans import check, config, packets, review
from deltaloom.sources import diffs, endpoint, index_store, python_code, reports, repository

#: Where the parsed index of a repository is kept, below its root.
STORE = ".deltaloom/index"
MARKS = ["repo", "path", "module", "mtime", "size"]


def _snapshot(spark: SparkSession, root: str, cfg: config.Config):
    """(files, parse): the working tree, and a parser that takes unchanged files from the store and writes it anew."""
    files = repository.read_tree(spark, root, cfg.exclude, cfg.roots)
    if not cfg.use_cache:
        return files.drop("mtime", "size"), python_code.parsed

    def parse(known):
        store = str(Path(root) / STORE)
        rows = stage(index_store.refreshed(spark, known, store))
        if index_store.current(spark, store) is None or not rows.filter("error is null").select(*MARKS).exceptAll(spark.read.parquet(index_store.current(spark, store)).select(*MARKS)).isEmpty():
            index_store.save(rows, store)
        return rows

    return files, parse


def _selected(spark: SparkSession, args: argparse.Namespace, root: str) -> tuple[str | None, str]:
    """(diff, base) of what is asked about; None for whole files. Paths come first, then a pull request, a range, a base, the tree."""
    if args.paths:
        return None, "HEAD"
    if args.pr:
        return repository.pull_request(root, args.pr)
    return repository.diff_text(root, repository.default_base(root) if args.base == "auto" else args.base, args.staged, args.range)


def _index(spark: SparkSession, args: argparse.Namespace, cfg: config.Config) -> check.Index:
    root = repository.nearest_root(args.root)
    new, parse = _snapshot(spark, root, cfg)
    text, base = _selected(spark, args, root)
    none = new.select("repo", "path", "src").limit(0)
    if text is None:
        chosen = F.lit(False)
        for p in args.paths:
            inside = str((Path(args.root) / p).resolve().relative_to(Path(root).resolve()))
            chosen = chosen | (F.col("path") == inside) | F.col("path").startswith(inside.rstrip("/") + "/") | F.lit(inside == ".")
        ix = check.build_index(none, new, spark.createDataFrame([], "repo string, text string"), stage, parse)
        ix.diffs = diffs.whole_file(new.filter(chosen))
        return ix
    touched = [f for f in diffs.parse_diff(text) if f["path"].endswith(".py")]
    old = repository.files_at(spark, root, base, [f["old_path"] or f["path"] for f in touched])
    ix = check.build_index(old, new, spark.createDataFrame([("", text)], "repo string, text string"), stage, parse)
    if args.untracked:
        more = [p for p in repository.untracked(root) if p not in {f["path"] for f in touched}]
        ix.diffs = stage(ix.diffs.unionByName(diffs.whole_file(new.filter(F.col("path").isin(more)))))
    return ix


def _endpoint(args: argparse.Namespace, cfg: config.Config) -> endpoint.Endpoint:
    return endpoint.Endpoint(args.host or cfg.host, args.model or cfg.model, cfg.num_ctx, cfg.timeout)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="deltaloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("check", "context", "review", "index", "doctor", "models", "init"):
        p = sub.add_parser(name)
        p.add_argument("--root", default=".")
        p.add_argument("--json", action="store_true")
        if name in ("review", "doctor", "models"):
            p.add_argument("--host")
            p.add_argument("--model")
        if name in ("check", "context", "review"):
            p.add_argument("--pr", type=int)
            p.add_argument("--untracked", action="store_true")
            p.add_argument("--base")
            p.add_argument("--range")
            p.add_argument("--staged", action="store_true")
            p.add_argument("--fail-on")
            p.add_argument("--max-callers", type=int)
            p.add_argument("paths", nargs="*")
        if name == "index":
            p.add_argument("--top", type=int, default=10)
            p.add_argument("--symbol")
    args = parser.parse_args(argv)
    if args.command == "init":
        (Path(args.root) / config.FILE).write_text(config.TEMPLATE, encoding="utf-8")
        return 0
    cfg = config.load(Path(args.root), fail_on=getattr(args, "fail_on", None), max_callers=getattr(args, "max_callers", None))
    if args.command in ("doctor", "models"):
        return _tell(args, cfg)
    spark = SparkSession.builder.appName("deltaloom").getOrCreate()
    try:
        if args.command == "index":
            return _show_index(spark, args, cfg)
        ix = _index(spark, args, cfg)
        if args.command == "context":
            found = packets.with_prompts(packets.build(ix, cfg, repository.history(spark, args.root) if cfg.co_change else None))
            print("[" + ",\n".join(r["json"] for r in reports.packets_json(found).orderBy("place").collect()) + "]" if args.json else reports.packets_text(found))
            return 0
        found, calls = stage(check.findings(ix, cfg.min_confidence)), None
        if args.command == "review":
            asked = packets.with_prompts(packets.build(ix, cfg, repository.history(spark, args.root) if cfg.co_change else None), found)
            found, calls = review.review(stage(asked), _endpoint(args, cfg).clamped(), found, cfg.workers, cfg.min_confidence, cfg.verify)
            found = stage(found)
        if args.json:
            print("\n".join(r["json"] for r in reports.findings_json(found, review.summary(found, calls)).collect()))
        else:
            print(reports.findings_text(found, colour=reports.wants_colour(sys.stdout, dict(os.environ))))
        return review.gate(found, cfg.fail_on)
    except (repository.GitError, endpoint.EndpointError) as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    finally:
        clear()


def _tell(args: argparse.Namespace, cfg: config.Config) -> int:
    """doctor: whether the model can be asked, and with what context; models: their names."""
    asked = _endpoint(args, cfg)
    try:
        if args.command == "models":
            print(*asked.models(), sep="\n")
            return 0
        well, said = asked.health()
        print(said)
        own = asked.context_length() if well else None
        print(f"context: {asked.clamped().num_ctx} tokens" + (f", the model has {own}" if own else ""))
        print(f"settings: {cfg.source or 'defaults'}; repository: {repository.nearest_root(args.root)}")
        return 0 if well else 1
    except endpoint.EndpointError as e:
        print(e, file=sys.stderr)
        return 2


def _show_index(spark: SparkSession, args: argparse.Namespace, cfg: config.Config) -> int:
    """Statistics, the most central symbols, or symbols with a text in their name and their callers."""
    from deltaloom.operators.graph import pagerank
    from deltaloom.operators.ranking import first_wins
    from deltaloom.plans.link import statistics

    root = repository.nearest_root(args.root)
    new, parse = _snapshot(spark, root, cfg)
    ix = check.build_index(new.select("repo", "path", "src").limit(0), new, spark.createDataFrame([], "repo string, text string"), stage, parse)
    if args.symbol:
        hits = ix.symbols.filter(F.contains("fqname", F.lit(args.symbol))).orderBy("fqname").limit(20).select("fqname", F.col("path").alias("defined"), F.col("lineno").alias("at"))
        sites = first_wins(ix.linked.select(F.col("callee").alias("fqname"), "path", "line", "tag", "ord"), ["fqname", "path", "line"], ["ord"])
        for r in hits.join(sites, "fqname", "left").orderBy("fqname", "path", "line").collect():
            print(f"{r['fqname']} ({r['defined']}:{r['at']})", f"<- {r['path']}:{r['line']} [{r['tag']}]" if r["path"] else "")
        return 0
    print(*(r.asDict() for r in statistics(ix.parsed, ix.symbols, ix.calls, ix.linked, ix.dropped).collect()))
    ranks = pagerank(ix.linked.select(F.regexp_replace("caller", r"\.<module>$", "").alias("src"), F.col("callee").alias("dst")))
    for r in ranks.orderBy(F.desc("score"), F.desc("node")).limit(args.top).collect():
        print(f"{r['score']:.5f} {r['node']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
