"""Price catalogues, exchange rates and settings from files."""

from __future__ import annotations

import json
import tomllib
import uuid
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pricing import Prices, catalogue
from ..schema import PRICE
from ..staging import local_path
from .base import no_path

TTL_S = 24 * 3600

COSTS = (
    "struct<input_cost_per_token:double,output_cost_per_token:double,reasoning_output_cost_per_token:double,reasoning_cost_per_token:double,"
    "cache_creation_input_token_cost:double,cache_creation_input_token_cost_above_1hr:double,cache_read_input_token_cost:double>"
)


def price_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Rates by lookup key from a JSON object of models."""
    text = spark.read.text(path, wholetext=True)
    models = text.select(F.explode(F.from_json("value", f"map<string,{COSTS}>")).alias("name", "costs"))
    return catalogue(models)


class CatalogueError(ValueError):
    """A price file that is there cannot be read."""


def _modified(spark: SparkSession, path: str) -> float | None:
    """When a file was written, in seconds; null if it is not there."""
    try:
        rows = spark.read.format("binaryFile").load(path).select(F.unix_millis("modificationTime")).collect()  # one file
    except Exception as e:
        if not no_path(e):
            raise
        return None
    return rows[0][0] / 1000 if rows else None


def _cached(spark: SparkSession, path: str, modified: float, now_s: float, ttl_s: int) -> Prices:
    """The prices of a cache file; CatalogueError if it is no JSON object."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{COSTS}>").isNotNull().alias("ok")).collect()  # one row
    if not whole or not whole[0]["ok"]:
        raise CatalogueError(f"malformed price file {path}")
    age = int(now_s - modified) if modified <= now_s else 2**63 - 1  # a file of the future is of no known age
    return Prices(price_catalogue(spark, path), "cache_stale" if age > ttl_s else "cache", age, int(modified))


def load_prices(spark: SparkSession, paths: list[str], now_s: float, offline: bool = True, fetch: Callable[[], str | None] | None = None, ttl_s: int = TTL_S) -> Prices:
    """Prices by the state of their cache, the first of paths that is there.

    Offline: that file, whatever its age (cache or cache_stale); a malformed one is an error; without any only fallback rates are left.
    Else: a fresh file; or what fetch brings (the path of a new file, saved as the first of paths; none if that fails): live;
    or a stale file, where a malformed one is an error; or fallback rates. A malformed file does not stand in the way of a fetch.
    """
    seen = [(p, t) for p in paths if (t := _modified(spark, p)) is not None][:1]
    cached = lambda: _cached(spark, *seen[0], now_s, ttl_s) if seen else Prices(spark.createDataFrame([], PRICE), "fallback")
    if offline:
        return cached()
    if seen:
        try:
            if (found := cached()).source == "cache":
                return found
        except CatalogueError as e:
            warnings.warn(f"{e}: fetched anew", stacklevel=2)
    if fetch is not None and (new := fetch()) is not None:
        if paths:
            _saved(new, paths[0])
        return Prices(price_catalogue(spark, new), "live")
    return cached()


def _saved(new: str, path: str) -> None:
    """Copy a price file into the cache under another name and then put it in place; a cache that cannot be written is no error."""
    try:
        (source, a), (target, b) = local_path(new), local_path(path)
        target.create_dir(b.rpartition("/")[0], recursive=True)
        held = f"{b}.{uuid.uuid4().hex}"
        with source.open_input_stream(a) as given, target.open_output_stream(held) as out:
            while block := given.read(1 << 20):
                out.write(block)
        target.move(held, b)
    except OSError as e:
        warnings.warn(f"the prices could not be saved: {e}", stacklevel=2)


def exchange_rates(path: str) -> dict[str, float]:
    """Rates for a dollar from {"rates": {...}} or a plain object."""
    found = json.loads(Path(path).read_text())
    return {k.upper(): float(v) for k, v in found.get("rates", found).items()}


def settings(paths: list[str], **given) -> dict:
    """The first file that exists, under what is given by name (null is not given); if the file cannot be read that is an error, later ones do not stand in."""
    found: dict = {}
    for p in paths:
        if Path(p).exists():
            found = tomllib.loads(Path(p).read_text())
            break
    return found | {k: v for k, v in given.items() if v is not None}
