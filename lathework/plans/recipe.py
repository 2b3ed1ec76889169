"""Recipes: cleans, types and an ordered list of transforms, as data; replayed, saved, or emitted as a script."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleans, formula
from ..operators import aggregate, models, pivot, review, transforms

#: Clean operations by kind: Column and arguments to Column.
CLEANS = {
    "trim": lambda c, a: cleans.trim(c),
    "case": lambda c, a: cleans.case(c, a["how"]),
    "replace": lambda c, a: cleans.replace(c, a["old"], a["new"], a.get("ignore_case", False)),
    "toNumber": lambda c, a: cleans.to_number(c, a.get("comma", False)),
    "signSuffix": lambda c, a: cleans.sign_suffix(c),
    "escapeFormulas": lambda c, a: cleans.escape_formulas(c),
    "keepNumbers": lambda c, a: cleans.keep_numbers(c),
    "keepText": lambda c, a: cleans.keep_text(c),
    "mask": lambda c, a: cleans.mask(c, a.get("first", 0), a.get("last", 0)),
    "hash": lambda c, a: cleans.hashed(c, a.get("salt", "")),
    "recode": lambda c, a: cleans.recode(c, a["map"]),
    "toDate": lambda c, a: cleans.to_date(c, a.get("order", "dmy")),
    "numberToDate": lambda c, a: cleans.number_to_date(c, a["kind"]),
    "cast": lambda c, a: cleans.cast(c, a["to"], a.get("on_fail", "coerce")),
    "repairDecimal": lambda c, a: cleans.repair_decimal(c, a.get("comma", False)),
    "fixMojibake": lambda c, a: review.fix_mojibake(c),
}
#: Dimensions of an aggregate step by kind.
DIMS = {"value": aggregate.Value, "time": aggregate.Time, "datePart": aggregate.DatePart, "binWidth": aggregate.BinWidth, "binQuantile": aggregate.BinQuantile, "cohort": aggregate.Cohort, "since": aggregate.Since}

#: Transforms by kind: table and arguments to table.
TRANSFORMS = {
    "drop": lambda df, a, o: transforms.drop(df, a["column"]),
    "round": lambda df, a, o: transforms.round_column(df, a["column"], a["decimals"]),
    "derive": lambda df, a, o: _derive(df, a, o),
    "clip": lambda df, a, o: transforms.clip(df, a["column"], a.get("low"), a.get("high"), a.get("mode", "limit")),
    "winsorize": lambda df, a, o: transforms.winsorize(df, a["column"], a["percent"]),
    "splitColumn": lambda df, a, o: pivot.split_column(df, a["column"], a["delimiter"], a.get("regex", False), a.get("drop_empty", False), a.get("prefix")),
    "explodeColumn": lambda df, a, o: pivot.explode_column(df, a["column"], a["delimiter"], a.get("regex", False)),
    "combineDate": lambda df, a, o: transforms.combine_date(df, a["roles"], a.get("name", "date")),
    "impute": lambda df, a, o: transforms.impute(df, a["column"], a["method"], a.get("value"), a.get("by"), o),
    "rename": lambda df, a, o: transforms.rename(df, a["names"]),
    "flagAnomalies": lambda df, a, o: transforms.flag_anomalies(df, a["column"], a.get("name")),
    "knn": lambda df, a, o: models.knn_impute(df, a["column"], a["predictors"], a.get("k", 5)),
    "aggregate": lambda df, a, o: _aggregate(df, a),
    "dedupe": lambda df, a, o: transforms.dedupe(df, a.get("keep", "first"), o),
    "groupBy": lambda df, a, o: transforms.group_simple(df, a["dim"], a["agg"], a.get("column")),
    "melt": lambda df, a, o: pivot.melt(df, a["ids"], a.get("values"), order=o),
    "spread": lambda df, a, o: pivot.spread(df, a["ids"], a["key"], a["value"], a.get("agg", "first"), o),
}


def _aggregate(df: DataFrame, a: dict) -> DataFrame:
    """Grouped measures: dims are {kind, column, ...}, measures {agg, column, ...}, with fill, sort and limit."""
    dims = tuple(DIMS[d["kind"]](**{k: v for k, v in d.items() if k != "kind"}) for d in a["dims"])
    measures = tuple(aggregate.Measure(**{k: aggregate.Where(**v) if k == "where" and v else v for k, v in m.items()}) for m in a["measures"])
    sort = tuple(a["sort"]) if a.get("sort") else None
    return aggregate.aggregate(df, aggregate.View(dims, measures, fill=a.get("fill"), sort=sort, limit=a.get("limit")))


def _derive(df: DataFrame, a: dict, order: str) -> DataFrame:
    try:
        value = formula.Compiler(df, order).column(a["formula"])
    except formula.FormulaError:
        return df
    return transforms.derive(df, a["name"], value, a.get("at"))


@dataclass
class Recipe:
    """Cleans by column, null policy by column, types by column, then transforms in order."""

    cleans: dict[str, list[dict]] = field(default_factory=dict)
    nulls: dict[str, dict] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    steps: list[dict] = field(default_factory=list)
    order: str = "_row_id"

    def to_json(self) -> str:
        return json.dumps(self.__dict__, indent=1, ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        return cls(**json.loads(text))

    def apply(self, df: DataFrame) -> DataFrame:
        """Replay on a table; a step whose column is missing is skipped."""
        for c, ops in self.cleans.items():
            if c in df.columns:
                for op in ops:
                    if op["op"] == "setCells":
                        edits = {e["row"]: e["to"] for e in op["edits"]}
                        df = df.withColumn(c, cleans.set_cells(F.col(f"`{c}`"), F.col(self.order), edits))
                    else:
                        df = df.withColumn(c, CLEANS[op["op"]](F.col(f"`{c}`"), op))
        for c, policy in self.nulls.items():
            if c in df.columns:
                missing = cleans.is_missing(F.col(f"`{c}`"), tuple(policy.get("extra", ())), tuple(policy.get("keep", ())))
                df = df.withColumn(c, F.when(~missing, F.col(f"`{c}`")))
        for c, t in self.types.items():
            if c in df.columns:
                df = df.withColumn(c, cleans.cast(F.col(f"`{c}`"), t))
        for step in self.steps:
            if "column" in step and step["op"] != "groupBy" and step["column"] not in df.columns:
                continue
            df = TRANSFORMS[step["op"]](df, step, self.order)
        return df

    def renamed(self, names: dict[str, str]) -> Recipe:
        """The recipe for a table whose columns have new names: everything that names one follows, formulas too."""

        def follow(x):
            if isinstance(x, dict):
                out = {}
                for k, v in x.items():
                    if k in ("column", "key", "value", "dim", "weight", "entity", "order") and isinstance(v, str):
                        out[k] = names.get(v, v)
                    elif k in ("ids", "values", "by", "predictors") and isinstance(v, list):
                        out[k] = [names.get(c, c) for c in v]
                    elif k in ("formula", "expr") and isinstance(v, str):
                        out[k] = formula.rename(v, names)
                    elif k == "names" and isinstance(v, dict):
                        out[k] = {names.get(c, c): n for c, n in v.items()}
                    elif k == "roles" and isinstance(v, dict):
                        out[k] = {r: names.get(c, c) for r, c in v.items()}
                    else:
                        out[k] = follow(v)
                return out
            return [follow(v) for v in x] if isinstance(x, list) else x

        keyed = lambda d: {names.get(c, c): v for c, v in d.items()}
        return Recipe(keyed(self.cleans), keyed(self.nulls), keyed(self.types), [follow(s) for s in self.steps], names.get(self.order, self.order))

    def script(self, source: str) -> str:
        """A PySpark script that replays this recipe on ``source``."""
        return "\n".join(
            [
                "from pyspark.sql import SparkSession",
                "from lathework.plans.recipe import Recipe",
                "",
                "spark = SparkSession.builder.getOrCreate()",
                f"recipe = Recipe.from_json({self.to_json()!r})",
                f"df = recipe.apply(spark.read.parquet({source!r}))",
                "df.show()",
                "",
            ]
        )
