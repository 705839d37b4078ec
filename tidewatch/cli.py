"""Command line: run, watch, show, summary, benchmark, validate, plan, lineage, characterize, verify."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_path(spark: SparkSession, path: str, out_dir: str, config: object, history_root: str | None = None, site: str | None = None, frozen: str | None = None, external: str | None = None, prior: str | None = None, channels: dict | None = None) -> dict:
    """Analyses what a path holds; writes report (JSON and a page), CSV, alerts and manifest to out_dir, sends alerts through the channels (those of the
    settings, if none are given; one that fails is reported, and the run goes on) and, with a history, records the run."""
    from tidewatch.operators import baseline
    from tidewatch.operators.history import History
    from tidewatch.plans.run import analyse, record
    from tidewatch.sinks import outputs
    from tidewatch.sources.reports import external_signals, ingest

    got = ingest(spark, path, config.rank)
    if got.counts is None:
        raise SystemExit("no abundance in the input")
    history = History(spark, history_root) if history_root else None
    base = baseline.load(spark, frozen, site or "all") if frozen else None
    out = analyse(spark, got.counts, config, history, frozen=base, reads=got.reads, external=external_signals(spark, external) if external else None, prior=baseline.load_document(spark, prior) if prior else None, species=got.species)
    text = outputs.report_document(out["report"], {"input": path, "rank": config.rank, "run_date": config.run_date or ""}).first()["json"]
    store = outputs.Storage(spark, out_dir)
    store.put_bytes("report.json", text.encode())
    store.put_bytes("report.html", outputs.write_html(out["report"]).encode())
    sent = outputs.dispatch(out["alerts"], channels if channels is not None else outputs.channels_of(config.alert_channels, config.run_date or ""))
    outputs.csv_rows(out["report"], config.run_date or "").coalesce(1).write.mode("overwrite").csv(f"{out_dir}/csv", header=True)
    out["alerts"].coalesce(1).write.mode("overwrite").json(f"{out_dir}/alerts")
    if history:
        run_id, made = record(spark, out, history, config, [path], json.loads(text))
    else:
        run_id, made = None, outputs.manifest(spark, path, {}, json.loads(text))
    store.put_bytes("manifest.json", json.dumps(made, default=str).encode())
    store.point("latest", "report.json")
    return {"run_id": run_id, "report": f"{out_dir}/report.json", "sent": sent}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewatch")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, text in (("run", "analyse a file or directory of reports"), ("watch", "analyse each new file of a directory")):
        own = sub.add_parser(name, help=text)
        own.add_argument("path")
        own.add_argument("--out", required=True)
        own.add_argument("--settings", help="YAML or JSON file")
        own.add_argument("--rank", default=None)
        own.add_argument("--scorer", choices=["relative", "absolute"], default=None)
        own.add_argument("--no-network", action="store_true")
        own.add_argument("--history", help="root of the history's tables")
        own.add_argument("--run-date")
        own.add_argument("--baseline", help="root of saved baselines")
        own.add_argument("--site")
        own.add_argument("--prior", help="JSON document of a baseline for sites without history")
        own.add_argument("--external", help="table of an outside signal")
        if name == "watch":
            own.add_argument("--interval", default=None, help="as in '1 hour'; without it what is there is processed once")
            own.add_argument("--run-on-start", action="store_true")
    summary = sub.add_parser("summary", help="levels of a JSON report")
    summary.add_argument("report")
    for name in ("benchmark", "validate"):
        own = sub.add_parser(name, help="synthetic scenarios")
        own.add_argument("--seed", type=int, default=42)
        own.add_argument("--full", action="store_true", help="with novelty and network")
    plan = sub.add_parser("plan", help="sequencing depth for a prevalence")
    plan.add_argument("prevalence", type=float)
    plan.add_argument("--min-reads", type=int, default=3)
    lineage = sub.add_parser("lineage", help="species of a report with their context")
    lineage.add_argument("report")
    lineage.add_argument("--threshold", type=float, default=0.001)
    show = sub.add_parser("show", help="what a recorded run left about a site")
    show.add_argument("what", choices=["history", "pathogens", "cusum", "resistance", "curve", "network", "communities", "clusters", "outbreaks"])
    show.add_argument("--history", required=True)
    show.add_argument("--site")
    show.add_argument("--run", type=int)
    shape = sub.add_parser("characterize", help="confidence and risk of predicted structures (PDB files)")
    shape.add_argument("path")
    check = sub.add_parser("verify", help="check a manifest against its files and report")
    check.add_argument("manifest")
    check.add_argument("report")
    args = parser.parse_args(argv)
    if args.command == "plan":
        from tidewatch.operators.planning import Plan, targets

        print(json.dumps(targets(Plan(args.prevalence, args.min_reads))))
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command in ("run", "watch"):
        from dataclasses import replace

        from tidewatch.plans.run import Config

        config = Config.read(args.settings) if args.settings else Config()
        config = replace(config, **{k: v for k, v in {"rank": args.rank, "scorer": args.scorer, "run_date": args.run_date, "with_network": False if args.no_network else None}.items() if v is not None})
        if args.command == "run":
            print(json.dumps(run_path(spark, args.path, args.out, config, args.history, args.site, args.baseline, args.external, args.prior)))
        else:
            from tidewatch.streaming.watch import watch

            def process(path: str, _: DataFrame) -> None:
                run_path(spark, path, f"{args.out}/{path.rstrip('/').rsplit('/', 1)[-1]}", config, args.history, args.site, args.baseline, args.external, args.prior)

            watch(spark, args.path, f"{args.out}/state", process, interval=args.interval, run_on_start=args.run_on_start or not args.interval).awaitTermination()
    elif args.command == "summary":
        from tidewatch.sources.reports import report_samples

        report_samples(spark, args.report).groupBy("level").count().show()
    elif args.command in ("benchmark", "validate"):
        from tidewatch import synth

        (synth.benchmark if args.command == "benchmark" else synth.validation)(spark, seed=args.seed, full=args.full).show(truncate=False)
    elif args.command == "lineage":
        from tidewatch.operators.abundance import normalized
        from tidewatch.operators.scoring import annotate_lineages
        from tidewatch.sources.dims import lineages
        from tidewatch.sources.reports import reports

        found = annotate_lineages(normalized(reports(spark, args.report, "S")), lineages(spark), args.threshold)
        found.select("species", F.round("rel", 4).alias("share"), "who_label", "n_variants").orderBy(F.desc("share"), "species").show(100, truncate=False)
    elif args.command == "show":
        from tidewatch.operators.history import History

        history = History(spark, args.history)
        kinds = {"communities": "community", "clusters": "cluster"}
        if args.what in ("history", "pathogens", "cusum", "resistance", "curve") and not args.site:
            raise SystemExit("which site?")
        if args.what == "history":
            rows = history.series(site=args.site).select("site", "t.run_date", "x").orderBy("run_date")
        elif args.what == "network":
            rows = history.network(args.run)
        elif args.what == "outbreaks":
            rows = history.outbreaks(args.run)
        elif args.what in kinds:
            rows = history.members(kinds[args.what], args.run)
        else:
            rows = getattr(history, args.what)(args.site, args.run)
        for line in rows.toJSON().toLocalIterator():
            print(line)
    elif args.command == "characterize":
        from tidewatch.operators.characterize import risk_tiers, structure_confidence
        from tidewatch.sources.reports import lines

        atoms = lines(spark, args.path).select(F.col("sample").alias("name"), "line")
        titles = atoms.where(F.startswith("line", F.lit("TITLE"))).groupBy("name").agg(F.array_join(F.array_sort(F.collect_list(F.trim(F.substring("line", 11, 70)))), " ").alias("title"))
        risk_tiers(structure_confidence(atoms).join(titles, "name", "left").withColumn("title", F.coalesce("title", "name"))).show(truncate=False)
    else:
        from tidewatch.sinks.outputs import verify

        with open(args.manifest) as m, open(args.report) as r:
            got = verify(spark, json.load(m), json.load(r))
        print(json.dumps(got))
        return int(not got["all_passed"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
