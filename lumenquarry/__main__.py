"""Command line: analyse papers, feed topics, match message streams, clean labels, train the classifier.

Functions that a caller plugs in are named as ``module:function``.
"""

from __future__ import annotations

import argparse
import importlib
import logging
import time
from collections.abc import Callable

from pyspark.sql import SparkSession


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenquarry")
    sub = top.add_subparsers(dest="what", required=True)
    a = sub.add_parser("analyze", help="papers of a .jsonl file or a folder of PDF files")
    a.add_argument("inputs")
    a.add_argument("--out", default="out_lit")
    a.add_argument("--splitter", choices=["naive", "smart"], default="naive")
    a.add_argument("--classifier", default="", help="folder of a trained classifier")
    a.add_argument("--threshold", type=float, default=0.7)
    a.add_argument("--context", action="store_true")
    a.add_argument("--around", type=int, default=1)
    a.add_argument("--max-chars", type=int, default=600)
    a.add_argument("--similar", type=int, default=2, help="similar sentences as context, with an embedder")
    for name, what in (("embedder", "texts to vectors"), ("entities", "a text to (text, label) pairs"), ("works", "doi and title to a work's JSON"), ("tei", "a PDF's bytes to TEI")):
        a.add_argument(f"--{name}", default="", help=f"module:function, {what}")
    m = sub.add_parser("match", help="JSON-line files of typed messages, as a stream run to its end")
    m.add_argument("folder")
    m.add_argument("--out", required=True)
    m.add_argument("--checkpoint", required=True)
    m.add_argument("--files", type=int, default=0, help="files a batch at most, in place of rate limits of the workers")
    f = sub.add_parser("feed", help="topics of a file to messages of the stand-in workers, as files for match")
    f.add_argument("topics")
    f.add_argument("out")
    c = sub.add_parser("clean", help="a CSV file of labelled sentences")
    c.add_argument("source")
    c.add_argument("out")
    t = sub.add_parser("train", help="a classifier from labelled sentences (CSV or JSON lines)")
    t.add_argument("source")
    t.add_argument("--out", default="models/future")
    for p in (a, m, f, c, t):
        p.add_argument("--log", default="", help="a file that the log goes to besides the terminal")
    return top


def plugged(name: str) -> Callable | None:
    """The function that ``module:function`` names; None for nothing."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def log_to(path: str) -> logging.Logger:
    log = logging.getLogger("lumenquarry")
    log.setLevel(logging.INFO)
    log.handlers.clear()
    for handler in (logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    return log


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("lumenquarry").getOrCreate()
    log = log_to(args.log)
    log.info("%s begins", args.what)
    if args.what == "analyze":
        from .plans import analyze, ml
        from .sources import papers, sinks

        began, models = time.time(), None
        if args.classifier:
            model = ml.CalibratedClassifier.load(args.classifier)
            models = lambda s: ml.with_features(s, "sent").withColumn("ml_score", model.score(ml.F.col("features"))).drop("features")
        docs = papers.load(spark, args.inputs, **({} if args.inputs.lower().endswith(".jsonl") else {"tei_service": plugged(args.tei)}))
        if docs.isEmpty():
            log.warning("no inputs found")
            return 1
        works = papers.lookup(docs, plugged(args.works)) if args.works else None
        providers = {"entities": plugged(args.entities)} if args.entities else {}
        options = analyze.Options(splitter=args.splitter, threshold=args.threshold, context=args.context, around=args.around, similar=args.similar, max_chars=args.max_chars, embedder=plugged(args.embedder), works=works, providers=providers, models=models)
        done = analyze.analyze(docs, options).write(args.out, began)
        sinks.show(done.docs, done.questions, done.future, done.steps).show(truncate=False)
    elif args.what == "feed":
        from .operators import match
        from .sources import sinks

        topics = spark.read.text(args.topics).select(match.F.trim("value").alias("topic")).where("topic <> ''").distinct()
        both = sinks.events(match.stub_data(topics), "data_result").unionAll(sinks.events(match.stub_literature(topics), "lit_result"))
        both.write.mode("append").text(args.out)
    elif args.what == "match":
        from .streaming import matching, monitor

        progress = monitor.watch(spark)
        reader = spark.readStream.option("maxFilesPerTrigger", args.files) if args.files else spark.readStream
        matches = matching.match_stream(matching.from_wire(matching.parse(reader.text(args.folder))))
        run = matching.run_to_end(matching.records(matches), args.out, args.checkpoint, kind="json", name="match")
        monitor.settle(progress, run)
        spark.streams.removeListener(progress)
        for report in list(progress.reports):
            log.info("%s", report)
    elif args.what == "clean":
        from .sources import labels

        log.info("%s lines without a comma", labels.clean_csv(spark, args.source, args.out))
    else:
        from .plans import ml
        from .sources import labels

        data = ml.stratified_split(ml.with_features(labels.read_examples(spark, args.source)), key="sentence").cache()
        model = ml.CalibratedClassifier.fit(data.where("not is_test"))
        scored = data.where("is_test").withColumn("score", model.score(ml.F.col("features")))
        ml.report(scored.withColumn("prediction", (ml.F.col("score") >= 0.5).cast("int"))).show()
        model.save(args.out)
    log.info("%s ends", args.what)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
