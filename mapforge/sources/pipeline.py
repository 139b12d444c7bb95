"""Map making from a configuration file: spark-submit this module with -f file.ini [-o map.fits].

Sections: main (tod, matrix: parquet tables, or files: frames files between commas, with band and size; output), projection
(resolution in arcsec, method sharp or nearest), deglitching (method, nsigma), filter_median (length), mapper (kind naive,
ls or rls, solver cg, cgs or bicgstab, hyper, tol, maxiter). Values are typed: true and false are booleans, numbers are
numbers. A map of frames files whose output ends with .fits becomes an image with its coverage, any other one a table.
"""

from __future__ import annotations

import argparse
import configparser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import solvers
from ..functions.wcs import Wcs
from ..operators import pointing, timeline
from ..operators.algebra import Difference, Projection
from ..operators.deglitch import deglitch
from ..operators.storage import saved
from . import fits, observation

#: Fixed names of sections and keys, with the kind of their values.
KEYS = {
    "main": {"tod": str, "matrix": str, "files": str, "band": str, "size": float, "output": str}, "projection": {"resolution": float, "method": str},
    "deglitching": {"method": str, "nsigma": float}, "filter_median": {"length": int}, "mapper": {"kind": str, "solver": str, "hyper": float, "tol": float, "maxiter": int},
}
SOLVERS = {"cg": solvers.cg, "cgs": solvers.cgs, "bicgstab": solvers.bicgstab}
#: A sample of several slices.
SAMPLE = ["slice", "det", "t"]


def typed(text: str, kind: type) -> object:
    if kind is bool:
        if text.lower() not in ("true", "false", "yes", "no", "1", "0"):
            raise ValueError(f"{text!r} is no boolean")
        return text.lower() in ("true", "yes", "1")
    return kind(text)


def read_config(text: str) -> dict[str, dict[str, object]]:
    parser = configparser.ConfigParser()
    parser.read_string(text)
    out: dict[str, dict[str, object]] = {}
    for name in parser.sections():
        if name not in KEYS:
            raise ValueError(f"unknown section {name!r}; known: {', '.join(KEYS)}")
        for key, value in parser[name].items():
            if key not in KEYS[name]:
                raise ValueError(f"unknown key {key!r} in section {name!r}")
            out.setdefault(name, {})[key] = typed(value, KEYS[name][key])
    return out


def preprocess(tod: DataFrame, matrix: DataFrame, short: int | None = None, long: int | None = None, method: str | None = None, nsigma: float | None = None, keys: list[str] = ["det"]) -> DataFrame:
    """High-pass by a short median filter to find glitches; the masks go to the signal, which a long filter then smooths."""
    work = timeline.filter_median(tod, keys, "t", "value", short, "masked") if short else tod
    if method:
        marked = deglitch(matrix, work, nsigma, method, sample=[*keys, "t"])
        tod = tod.drop("masked").join(marked.select(*keys, "t", "masked"), [*keys, "t"])
    return timeline.filter_median(tod, keys, "t", "value", long, "masked") if long else tod


def compressed(tod: DataFrame, matrix: DataFrame, factor: int, keys: list[str] = ["det"]) -> tuple[DataFrame, DataFrame]:
    """A signal and its matrix as means of blocks of `factor` samples. A block with a masked sample is masked; factor divides all lengths.

    Entries of one block and pixel become one, so that the matrix is that of the compression after the projection.
    """
    timeline.check_divides(tod, keys, factor)
    block = F.floor(F.col("t") / factor).cast("long").alias("t")
    y = tod.groupBy(*keys, block).agg((F.sum("value") / factor).alias("value"), F.max("masked").alias("masked"))
    m = matrix.groupBy(*keys, block, "pixel").agg((F.sum(F.col("weight").cast("double")) / factor).alias("weight"))
    return y, m


def maps(tod: DataFrame, matrix: DataFrame, factor: int = 1, keys: list[str] = ["det"], **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signal, map, map of the mask) after preprocess(); with a factor the maps are those of the compressed signal.

    The map of the mask is the weighted share of masked samples of each pixel, 0 to 1.
    """
    tod = saved(preprocess(tod, matrix, keys=keys, **options), "preprocessed")
    y, m = compressed(tod, matrix, factor, keys) if factor > 1 else (tod, matrix)
    share = y.select(*keys, "t", F.col("masked").cast("double").alias("value"))
    return y, solvers.mapper_naive(m, y, [*keys, "t"]), solvers.mapper_naive(m, share, [*keys, "t"], mask=None)


def observed(spark: SparkSession, files: list[str], band: str, size: float, resolution: float, method: str = "sharp") -> tuple[DataFrame, DataFrame, Wcs]:
    """(tod, matrix, header) of frames files: each is a slice. Removed pointings and detectors are in neither table."""
    obs = observation.open_frames(spark, files)
    columns = observation.BANDS[band][1]
    camera = observation.detectors(spark, band, size).withColumn("det", (F.col("row") * columns + F.col("column")).cast("int"))  # as the signal's rows
    places, camera = saved(obs.pointing.filter("not removed"), "pointing"), camera.filter("not removed")
    wcs = pointing.map_header(places, camera, resolution)
    kinds = {"sharp": pointing.sharp_matrix, "nearest": pointing.nearest_matrix}
    if method not in kinds:
        raise ValueError(f"unknown projection {method!r}; known: {', '.join(kinds)}")
    matrix = saved(kinds[method](places, camera, wcs).select(*SAMPLE, "k", "pixel", "weight"), "matrix")
    return obs.get_tod().select(*SAMPLE, "value", "masked"), matrix, wcs


def run(spark: SparkSession, config: dict[str, dict[str, object]]) -> DataFrame:
    """The map (pixel, value, coverage)."""
    main = config["main"]
    if "files" in main:
        given = config.get("projection", {})
        files = [f.strip() for f in main["files"].split(",") if f.strip()]
        tod, matrix, wcs = observed(spark, files, main.get("band", "blue"), main.get("size", 3.2), given.get("resolution", 3.2), given.get("method", "sharp"))
        sample = SAMPLE
    else:
        tod, matrix, wcs, sample = spark.read.parquet(main["tod"]), spark.read.parquet(main["matrix"]), None, ["det", "t"]
    glitch = config.get("deglitching", {})
    length = config.get("filter_median", {}).get("length")
    tod = preprocess(tod, matrix, short=length, long=length, method=glitch.get("method", "mad" if glitch else None), nsigma=glitch.get("nsigma"), keys=sample[:-1])
    mapper = config.get("mapper", {})
    naive = solvers.mapper_naive(matrix, tod, sample)
    kind = mapper.get("kind", "naive")
    if kind == "naive":
        out = naive
    elif kind in ("ls", "rls"):
        clean = saved(tod.select(*sample, F.when(F.col("masked"), 0.0).otherwise(F.col("value")).alias("value")), "clean")
        hyper = mapper.get("hyper", 1.0) if kind == "rls" else 0.0
        prior = [Difference([], "pixel")] if hyper else None
        got = solvers.mapper_rls(clean, Projection(matrix, sample), hyper=hyper, priors=prior, tol=mapper.get("tol", 1e-5), most=mapper.get("maxiter", 300), solver=SOLVERS[mapper.get("solver", "cg")])
        out = got.x.join(naive.select("pixel", "coverage"), "pixel", "left")
    else:
        raise ValueError(f"unknown mapper {kind!r}; known: naive, ls, rls")
    if "output" in main:
        if wcs is not None and main["output"].endswith(".fits"):
            fits.write_map(out, main["output"], wcs.to_header(), coverage="coverage")
        else:
            out.write.mode("overwrite").parquet(main["output"])
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("-f", "--file", required=True, help="configuration file")
    parser.add_argument("-o", "--output", help="where the map goes, instead of what the file says")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    text = "\n".join(r.value for r in spark.read.text(given.file).collect())
    config = read_config(text)
    if given.output:
        config["main"]["output"] = given.output
    run(spark, config)


if __name__ == "__main__":
    main()
