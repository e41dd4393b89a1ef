"""Request bodies (JSON text) -> accepted / rejected rows.

Three request variants share one job; they differ in the required keys:

* ``hadoop``  : input, output, callback_url must be present (any value);
* ``micro``   : input, callback_url must be present; output defaults to ''
  (an explicit null stays null);
* ``pipeline``: ipy_path and pipeline must be present and not an empty
  value ('', 0, false, null, [], {}).

The first missing key in list order is reported with code 400; a body
that is not a JSON object is rejected with code 400 as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required keys per variant, in the order they are checked.
REQUIRED = {
    "hadoop": ("input", "output", "callback_url"),
    "micro": ("input", "callback_url"),
}
PIPELINE_KEYS = ("ipy_path", "pipeline")
# Messages in our own words.
PIPELINE_ERROR = "a pipeline request needs a value for ipy_path and for pipeline"
INVALID_ERROR = "body is not a JSON object"
MISSING_ERROR = "required key absent: "
# JSON values that count as no value (null and an absent key read as NULL).
EMPTY_VALUES = ("", "0", "0.0", "false", "[]", "{}")


def _first_missing(keys: Column, required: tuple[str, ...]) -> Column:
    expr = None
    for k in required:
        cond = ~F.array_contains(keys, k)
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    return expr


def parse_requests(df: DataFrame, body_col: str = "body",
                   variant_col: str = "variant") -> DataFrame:
    """Adds: accepted, code, error, input, output, callback_url."""
    body = F.col(body_col)
    keys = F.json_object_keys(body)
    variant = F.col(variant_col)
    # one parse into a struct of the five fields (JSON null and missing both
    # read as NULL; presence is decided by ``keys``)
    fields = ("input", "output", "callback_url") + PIPELINE_KEYS
    parsed = F.from_json(body, ", ".join(f"{k} string" for k in fields))
    val = {k: parsed.getField(k) for k in fields}
    missing = (F.when(variant == "hadoop", _first_missing(keys, REQUIRED["hadoop"]))
                .when(variant == "micro", _first_missing(keys, REQUIRED["micro"])))
    blank_pipeline = F.lit(False)
    for k in PIPELINE_KEYS:
        blank_pipeline = blank_pipeline | F.coalesce(val[k].isin(*EMPTY_VALUES), F.lit(True))
    error = (F.when(keys.isNull(), F.lit(INVALID_ERROR))
              .when((variant == "pipeline") & blank_pipeline, F.lit(PIPELINE_ERROR))
              .when(missing.isNotNull(), F.concat(F.lit(MISSING_ERROR), missing)))
    no_output = (variant == "micro") & ~F.array_contains(keys, "output")
    output = F.when(no_output, F.lit("")).otherwise(val["output"])
    accepted = error.isNull()
    return df.select(
        "*", accepted.alias("accepted"),
        F.when(accepted, 200).otherwise(400).cast("bigint").alias("code"),
        error.alias("error"),
        F.when(accepted & (variant != "pipeline"), val["input"]).alias("input"),
        F.when(accepted & (variant != "pipeline"), output).alias("output"),
        F.when(accepted & (variant != "pipeline"), val["callback_url"]).alias("callback_url"))
