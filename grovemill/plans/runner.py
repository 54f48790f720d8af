"""From a table on disk to a saved model, by a configuration or by command line: python -m grovemill.plans.runner --inputPath ..."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from grovemill.functions.losses import LOSSES, Loss
from grovemill.operators.binning import BinningOptions, Discretization
from grovemill.plans.ensembles import BoostOptions, boost
from grovemill.plans.model import BoostedTrees, TreeWriter
from grovemill.plans.state import Log, Notifiee
from grovemill.sources.tables import FORMATS, Delimited, read, roles


@dataclass(frozen=True)
class Config:
    """Field names are those of the command line's options."""

    inputPath: str
    outputPath: str
    inputFormat: str = "csv"
    delimiter: str = "\t"
    escapeStr: str = "\\"
    quoteStr: str = '"'
    headerExists: bool = False
    fracTraining: float = 0.8
    labelColIndex: int = 0
    catColIndices: tuple[int, ...] = ()
    colsToIgnoreIndices: tuple[int, ...] = ()
    numTrees: int = 100
    maxTreeDepth: int = 3
    minSplitSize: int = 10
    lossFunction: str | Loss = "gaussian"
    catSplitType: str = "ordered"
    baggingRate: float = 0.5
    bagWithReplacement: bool = False
    shrinkage: float = 0.001
    fineTuneTerminalNodes: bool = True
    checkpointDir: str | None = None
    predCheckpointInterval: int = 5
    idCacheCheckpointInterval: int = 10
    verbose: bool = False
    discType: str = "equal_frequency"
    maxNumericBins: int = 256
    maxCatCardinality: int = 256
    useFeatureHashingOnCat: bool = True
    maxSampleSizeForDisc: int = 5000
    repartitionSize: int | None = None
    pauseDuration: int = 0


#: Rows that verbose runs show.
PEEK = 50


def options_of(c: Config) -> BoostOptions:
    binning = BinningOptions(Discretization(c.discType), c.maxNumericBins, c.maxCatCardinality, c.useFeatureHashingOnCat, c.maxSampleSizeForDisc)
    return BoostOptions(c.numTrees, c.maxTreeDepth, c.minSplitSize, c.lossFunction, c.catSplitType, c.baggingRate, c.bagWithReplacement, c.shrinkage, c.fineTuneTerminalNodes, c.fracTraining, c.predCheckpointInterval, binning=binning)


def run(spark: SparkSession, c: Config, factory: Callable[[BoostedTrees], object] | None = None, notifiee: Notifiee | None = None, schema: StructType | None = None, writer: TreeWriter | None = None) -> object:
    """Reads, trains, saves to outputPath, and returns what the factory makes of the model (the model itself without one). The model holds
    what a factory may want: names, types, encoders and bins of features, the label's name and values, deviances, the best
    number of trees. The writer is given each tree as it comes.

    Node ids are found by walking the trees, so idCacheCheckpointInterval has nothing to do; it is accepted.
    """
    told = notifiee or Log()
    if c.checkpointDir:
        spark.conf.set("spark.checkpoint.dir", c.checkpointDir)
    if c.pauseDuration:
        time.sleep(c.pauseDuration)
    df = read(spark, c.inputPath, c.inputFormat, Delimited(c.delimiter, c.escapeStr, c.quoteStr, c.headerExists), schema, c.repartitionSize)
    r = roles(df, c.labelColIndex, c.catColIndices, c.colsToIgnoreIndices)
    if c.verbose:
        told.status("first rows:\n" + "\n".join(map(str, df.take(PEEK))))
    told.status(f"label {r.label}, features {r.features}, categories {sorted(r.categorical)}")
    model = boost(df, r.label, r.features, r.categorical, options_of(c), notifiee=told, writer=writer)
    model.save(spark, c.outputPath)
    if c.verbose:
        told.status(model.dump())
    return factory(model) if factory else model


def yes(text: str) -> bool:
    if text.lower() not in ("true", "false", "1", "0", "yes", "no"):
        raise argparse.ArgumentTypeError(f"not true or false: {text}")
    return text.lower() in ("true", "1", "yes")


def numbers(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(",") if x)


def parse(args: list[str]) -> Config:
    p = argparse.ArgumentParser(description="Trains gradient boosted trees from a table.")
    closed = {"inputFormat": FORMATS, "lossFunction": sorted(LOSSES), "catSplitType": ("ordered", "random", "multiway"), "discType": [d.value for d in Discretization]}
    for name, f in Config.__dataclass_fields__.items():
        kind = {"bool": yes, "int": int, "int | None": int, "float": float, "tuple[int, ...]": numbers}.get(f.type, str)
        needed = name in ("inputPath", "outputPath")
        p.add_argument(f"--{name}", type=kind, required=needed, default=None if needed else f.default, choices=closed.get(name))
    return Config(**vars(p.parse_args(args)))


def main(args: list[str] | None = None) -> None:
    config = parse(sys.argv[1:] if args is None else args)
    run(SparkSession.builder.appName("grovemill").getOrCreate(), config)


if __name__ == "__main__":
    main()
