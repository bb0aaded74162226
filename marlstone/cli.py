"""Command line: ``python -m marlstone.cli samples|train|evaluate|graph|profile ...``."""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import functions as F

from . import sinks
from .functions.text import first_token
from .operators import agents, forecast, graph, samples
from .operators.metrics import binary_metrics
from .providers import guess, hashed_score, lexicon, reflection, sketch
from .plans.shared import checkpoint_folder
from .session import session
from .sources import files
from .store import Store

#: Datasets that are cut to a range of days, both included.
RANGES = {"ACL18": ("2014-01-01", "2016-01-01")}


def build_samples(spark, price_dir: str, post_dir: str, dataset: str = "", seq_len: int = 5, train_rows: int | None = None):
    """Samples with their split from real files; the default summariser takes each day's first posts."""
    prices = files.read_prices(spark, price_dir)
    if dataset in RANGES:
        prices = samples.in_range(prices, *RANGES[dataset])
    days = samples.temporal_split(samples.labelled(prices), train_rows=train_rows)
    windows = samples.sample_windows(days, samples.extractive_summaries(files.read_posts(spark, post_dir)), seq_len)
    return windows.join(days.select("ticker", F.col("date").alias("end_date"), "split"), ["ticker", "end_date"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    sub = top.add_subparsers(dest="task", required=True)
    for name in ("samples", "train", "evaluate", "forecast"):
        p = sub.add_parser(name)
        p.add_argument("--price_dir")
        p.add_argument("--tweet_dir")
        p.add_argument("--dataset_name", default="", help="a registered dataset, or a folder of the usual layout below --base_path")
        p.add_argument("--base_path")
        p.add_argument("--seq_len", type=int, default=5)
        p.add_argument("--train_rows", type=int)
        p.add_argument("--save_dir", default="results")
        p.add_argument("--base_model", default="lexicon")
        p.add_argument("--num_reflect_trials", type=int, default=2)
        p.add_argument("--num_shots", type=int, default=4)
        p.add_argument("--store", help="folder of trials and answers: a run that was cut off goes on, and no model is asked twice")
    for name in ("graph", "profile"):
        p = sub.add_parser(name)
        p.add_argument("--root", required=True)
        p.add_argument("--save_dir", default="results")
        if name == "graph":
            p.add_argument("--mapping", required=True, help="CSV with header: ticker, entity")
            p.add_argument("--first", default="2020-01-01")
            p.add_argument("--last", default="2022-12-31")
    return top


def logger(folder: str) -> logging.Logger:
    """The program's log: to the console and, if the folder is a local one, to a file there."""
    log = logging.getLogger("marlstone")
    log.setLevel(logging.INFO)
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
        if "://" not in folder:
            os.makedirs(folder, exist_ok=True)
            log.addHandler(logging.FileHandler(os.path.join(folder, "marlstone.log")))
        for h in log.handlers:
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    return log


def run_graph(spark, args: argparse.Namespace) -> None:
    """Relationships of mapped companies, or the profile of the training quads."""
    entities = graph.first_names(files.read_entities(spark, f"{args.root}/entity2id.txt"))
    times = files.read_times(spark, f"{args.root}/time2id.txt").select("time_id", F.to_date("date_wk").alias("date_wk"))
    relations = files.read_relations(spark, f"{args.root}/relation2id.txt")
    if args.task == "graph":
        quads = files.read_quads(spark, [f"{args.root}/{x}.txt" for x in ("train", "valid", "test")]).join(times, "time_id")
        mapping = spark.read.csv(args.mapping, header=True, schema="ticker string, entity string")
        found = graph.relationships(quads, entities, mapping, args.first, args.last, relations)
        sinks.write_relationships(found, f"{args.save_dir}/relationships")
        sinks.write_relationships(graph.year_histogram(found, F.col("time")), f"{args.save_dir}/years")
        return
    quads = files.read_quads(spark, [f"{args.root}/train.txt"]).join(times, "time_id", "left")
    decoded = graph.decode(quads, entities, relations)
    for name, rows in {
        "stats": graph.dataset_stats(decoded),
        "types": graph.type_counts(decoded),
        "keywords": graph.keyword_entities(entities).select("id", "entity", "type_name"),
        "companies": entities.where(F.col("type_name") == graph.COMPANY).select("id", "entity"),
    }.items():
        sinks.write_relationships(rows, f"{args.save_dir}/{name}")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    log = logger(args.save_dir)
    spark = session(f"marlstone-{args.task}")
    if args.task in ("graph", "profile"):
        run_graph(spark, args)
        return
    price_dir, post_dir = args.price_dir, args.tweet_dir
    if args.dataset_name and args.base_path:
        if args.dataset_name not in files.REGISTRY:
            files.register(args.dataset_name)
        price_dir, post_dir = files.dataset_paths(args.dataset_name, args.base_path)
    rows = build_samples(spark, price_dir, post_dir, args.dataset_name, args.seq_len, args.train_rows)
    if args.task == "samples":
        sinks.write_samples_csv(rows, f"{args.save_dir}/samples")
        return
    checkpoint_folder(spark)
    store = Store(spark, args.store) if args.store else None
    if args.task == "forecast":
        metrics = forecast.evaluate(rows.where("split = 'test'"), sketch, guess, cache=store, asker=args.base_model)
        sinks.write_metrics(metrics, args.save_dir, args.base_model, args.dataset_name or None)
        log.info("%s", metrics.first())
        return
    numbered = rows.withColumn("sample_id", F.xxhash64("ticker", "end_date"))
    if args.task == "train":
        history = agents.run_trials(numbered.where("split = 'train'"), lexicon, reflection, args.num_reflect_trials, store, store, args.base_model)
        sinks.write_sft(agents.sft_rows(history), f"{args.save_dir}/sft")
        sinks.write_preferences(agents.preference_rows(history), f"{args.save_dir}/pairs")
        sinks.write_state(agents.latest(history), f"{args.save_dir}/agents")
        return
    asked = agents.initial(numbered.where("split = 'test'")).withColumn("prompt", agents.agent_prompt())
    best = agents.n_shots(asked.select("sample_id", "prompt"), lexicon, hashed_score, args.num_shots)
    said = asked.join(best, "sample_id").withColumn("response", F.col("answer")).withColumn("prediction", first_token(F.col("answer")))
    sinks.write_results(agents.result_rows(said), f"{args.save_dir}/answers")
    metrics = binary_metrics(said, "prediction", "target")
    sinks.write_metrics(metrics, args.save_dir, args.base_model, args.dataset_name or None)
    log.info("%s", metrics.first())


if __name__ == "__main__":
    main()
