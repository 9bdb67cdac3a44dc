"""Fit a cleaning plan on a table, apply it as one projection, account for every change.

Cleaning decisions depend on the data: how many spellings a column has, where its fences and median
lie, what share of its dates can be read. ``fit`` measures them on the table of distinct values and
records the decisions as a plan of constants; ``CleaningPlan.apply`` is then a single narrow select
that also works on new data and on streams.

Inside a column the order is fixed: text, numbers, dates, fills, types. A median is therefore taken
after capping, and a date that cannot be read is filled like any other missing value.
"""
from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrinse import schema
from sparkrinse.functions.dates import parse_date
from sparkrinse.functions.numbers import is_whole, outside, to_number
from sparkrinse.operators import frequency
from sparkrinse.operators.duplicates import COPIES, collapse_duplicates, duplicate_count
from sparkrinse.operators.quantiles import iqr_fences, per_column_constants, value_quantiles
from sparkrinse.operators.semantics import SemanticMapping, detect_semantics, looks_like_date, looks_like_email
from sparkrinse.operators.tidy import measure_columns
from sparkrinse.plans.config import NUMERIC_FILLS, TEXT_FILLS, CleaningConfig
from sparkrinse.plans.steps import Step, run_step, run_steps
from sparkrinse.staging import stage

# Names that protect a column from recasing or from becoming a number, names of
# columns that cannot be negative, and the thresholds of the rules.
UNCASED_NAMES = ("id", "uuid", "sku", "url", "email")
UNTYPED_NAMES = ("id", "date")
POSITIVE_NAMES = ("quantity", "price", "sales", "revenue")
CASING_FLOOR, CASING_SHARE = 50, 0.1
OUTLIER_MINIMUM = 10
# Columns of at most so many values are cleaned by looking their values up, some MB a column in every executor.
LOOKED_UP = 50_000
DATE_SHARE = 0.5
UNKNOWN = "Unknown"


@dataclass
class ColumnPlan:
    name: str
    steps: list[Step] = field(default_factory=list)


def _staged_steps(steps: list[Step]) -> list[Step]:
    """The steps of a column, texts to be read as dates trimmed beforehand."""
    return [s for step in steps for s in ([{"step": "trim"}, step] if step["step"] == "date" else [step])]


@dataclass
class CleaningPlan:
    """Decisions only, no data: can be stored as JSON and applied elsewhere."""

    columns: list[ColumnPlan]

    def apply(self, df: DataFrame) -> DataFrame:
        """Narrow projections over a table with the fitted columns (headers are trimmed first)."""
        df = trim_headers(df)
        kinds = {c.name: schema.type_of(df, c.name) for c in self.columns}
        df = df.select(*[schema.null_if_nan(df, c.name).alias(c.name) for c in self.columns])
        # The steps of one place after the other, so that a step that looks at a value several times reads a column
        # and does not repeat the steps before it.
        for place in range(max((len(_staged_steps(c.steps)) for c in self.columns), default=0)):
            cleaned = []
            for plan in self.columns:
                value, steps = schema.col(plan.name), _staged_steps(plan.steps)
                if place < len(steps):
                    value, kinds[plan.name] = run_step(value, kinds[plan.name], steps[place])
                cleaned.append(value.alias(plan.name))
            df = df.select(*cleaned)
        return df

    def to_json(self) -> str:
        return json.dumps([{"name": c.name, "steps": c.steps} for c in self.columns])

    @classmethod
    def from_json(cls, text: str) -> CleaningPlan:
        return cls([ColumnPlan(c["name"], c["steps"]) for c in json.loads(text)])


@dataclass
class AuditEntry:
    operation: str
    column: str
    records_affected: int
    description: str


@dataclass
class CleanResult:
    cleaned: DataFrame
    plan: CleaningPlan
    audit: list[AuditEntry]
    source: DataFrame
    before: dict[str, int | None]
    rows_after: int
    missing_after: int

    def audit_frame(self) -> DataFrame:
        """``step, ts, operation, column, records_affected, description``."""
        return audit_frame(self.cleaned.sparkSession, self.audit)

    def summary_frame(self) -> DataFrame:
        """Before and after counts in one row; only the remaining duplicates need another job."""
        remaining = duplicate_count(self.cleaned).select("duplicate_rows")
        if self.before["duplicates"] is None:
            self.before["duplicates"] = duplicate_count(self.source).first()["duplicate_rows"]
        kinds = {
            "rows_before": self.before["rows"],
            "columns_before": self.before["columns"],
            "missing_before": self.before["missing"],
            "duplicates_before": self.before["duplicates"],
            "rows_after": self.rows_after,
            "columns_after": len(self.plan.columns),
            "missing_after": self.missing_after,
        }
        rest = {
            "records_removed": self.before["rows"] - self.rows_after,
            "missing_cells_imputed": self.before["missing"] - self.missing_after,
            "total_operations": len(self.audit),
        }

        def constants(values: Mapping[str, int]) -> list[Column]:
            return [F.lit(v).cast("bigint").alias(k) for k, v in values.items()]

        return remaining.select(
            *constants(kinds), F.col("duplicate_rows").alias("duplicates_after"), *constants(rest)
        )


def audit_frame(spark: SparkSession, entries: list[AuditEntry]) -> DataFrame:
    now = datetime.now(timezone.utc)
    entries = entries or [
        AuditEntry("Quality Inspection", "All", 0, "Dataset inspected. No automated modifications were required.")
    ]
    rows = [
        (i, now, e.operation, e.column, e.records_affected, e.description) for i, e in enumerate(entries, start=1)
    ]
    return spark.createDataFrame(
        rows, "step INT, ts TIMESTAMP, operation STRING, `column` STRING, records_affected BIGINT, description STRING"
    )


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip blanks around column names; names that collide get ``_2``, ``_3``."""
    names: list[str] = []
    for raw in df.columns:
        base = name = raw.strip()
        suffix = 2
        while name in names:
            name, suffix = f"{base}_{suffix}", suffix + 1
        names.append(name)
    return df if names == df.columns else df.toDF(*names)


def clean(df: DataFrame, config: CleaningConfig | None = None) -> CleanResult:
    """Fit a plan on ``df`` and apply it to the same rows. ``df`` itself is left as it is."""
    return _Fitting(df, config or CleaningConfig()).run()


def fit(df: DataFrame, config: CleaningConfig | None = None) -> CleaningPlan:
    """A plan for other data of the same shape: text and sign steps stay in even where ``df`` needed none."""
    return _Fitting(df, config or CleaningConfig(), keep_idle=True).run().plan


def _typed(kind: T.DataType) -> Column:
    """A value of the table of distinct values in the type of its column."""
    if isinstance(kind, T.IntegralType):
        return F.col("whole").cast(kind)
    if schema.is_float(kind):
        return F.col("number").cast(kind)
    return F.col("text") if schema.is_text(kind) else F.col("text").try_cast(kind)


class _Fitting:
    """State of one fit: the rows, what was measured, and the steps decided so far."""

    def __init__(self, df: DataFrame, config: CleaningConfig, keep_idle: bool = False):
        self.config = config
        self.keep_idle = keep_idle
        self.original_headers = df.columns
        self.source = schema.nan_to_null(trim_headers(df))
        self.names = self.source.columns
        self.kinds: dict[str, T.DataType] = {f.name: f.dataType for f in self.source.schema.fields}
        self.roles: SemanticMapping = detect_semantics(self.names, config.role_overrides)
        self.steps: dict[str, list[Step]] = {c: [] for c in self.names}
        self.audit: list[AuditEntry] = []
        self._check_rules()

    # ---- which columns take part in which step: decided by name and type --------------------

    def _check_rules(self) -> None:
        for name, rule in self.config.custom_missing_rules.items():
            if name not in self.kinds:
                raise ValueError(f"rule for unknown column {name!r}")
            allowed = NUMERIC_FILLS if schema.is_number(self.kinds[name]) else TEXT_FILLS
            if rule not in allowed:
                raise ValueError(f"fill {rule!r} does not suit column {name!r}")

    def _is_cleanable_text(self, name: str) -> bool:
        is_date = name == self.roles.date or "date" in name.lower()
        return schema.is_text(self.kinds[name]) and not is_date

    def _text_steps(self, name: str) -> list[Step]:
        """Spacing, then e-mail or synonyms. Recasing is decided later, by cardinality."""
        steps: list[Step] = [{"step": "squeeze"}] if self.config.normalizes_spaces else []
        if looks_like_email(name, self.roles):
            return [*steps, {"step": "email"}]
        domain = next((d for d in ("payment", "status") if d in name.lower()), None)
        if self.config.standardize_known_categories and domain:
            steps.append({"step": "synonyms", "domain": domain})
        return steps

    def _may_recase(self, name: str) -> bool:
        if self.config.casing_strategy == "preserve" or looks_like_email(name, self.roles):
            return False
        return not any(part in name.lower() for part in UNCASED_NAMES)

    def _must_be_positive(self, name: str) -> bool:
        named = any(part in name.lower() for part in POSITIVE_NAMES)
        return self.config.fix_negative_values and (name in self.roles.money_columns or named)

    def _date_candidates(self) -> list[str]:
        found = [
            c
            for c in self.names
            if looks_like_date(c, self.roles) and (schema.is_text(self.kinds[c]) or schema.is_temporal(self.kinds[c]))
        ]
        return sorted(found, key=lambda c: c != self.roles.date)

    def _rule(self, name: str) -> str:
        default = (
            self.config.num_missing_strategy
            if schema.is_number(self.kinds[name])
            else self.config.cat_missing_strategy
        )
        return self.config.custom_missing_rules.get(name, default)

    # ---- the passes ---------------------------------------------------------------------------

    def run(self) -> CleanResult:
        self._collapse()
        self._first_pass()
        self._decide_text_signs_and_dates()
        self._fit_outliers()
        self._second_pass()
        self._decide_fills_and_types()
        plan = CleaningPlan([ColumnPlan(c, self.steps[c]) for c in self.names])
        return CleanResult(
            self._applied(plan), plan, self._ordered_audit(), self.source, self.before, self.total, self.missing_after,
        )

    def _applied(self, plan: CleaningPlan) -> DataFrame:
        """The same as ``plan.apply`` of the rows: texts of few values are looked up instead of computed in every row."""
        rows = self.rows.select(*[schema.col(c) for c in self.names])
        few = {
            c: self.steps[c] for c in self.scalars
            if self.kinds[c] == T.StringType() and self.steps[c] and 0 < self.found[c]["values"] <= LOOKED_UP
            and self._value(c)[1] == T.StringType()
        }
        if not few:
            return plan.apply(rows)
        name, done = F.col("column_name"), F.when(F.lit(False), F.lit(None))
        listed = self.values.where(name.isin(*few) & F.col("text").isNotNull())
        for c, steps in few.items():
            done = done.when(name == F.lit(c), run_steps(F.col("text"), T.StringType(), steps)[0])
        listed = stage(listed.select("column_name", "text", done.alias("cleaned")), "cleaned-values")
        for i, c in enumerate(few):
            own = listed.where(name == F.lit(c)).select(F.col("text").alias(f"__text{i}"), F.col("cleaned").alias(f"__cleaned{i}"))
            rows = rows.join(F.broadcast(own), schema.col(c) == F.col(f"__text{i}"), "left")
        looked_up = {
            c: F.when(schema.col(c).isNull(), run_steps(F.lit(None).cast("string"), T.StringType(), steps)[0]).otherwise(F.col(f"__cleaned{i}"))
            for i, (c, steps) in enumerate(few.items())
        }
        rows = rows.select(*[looked_up[c].alias(c) if c in few else schema.col(c) for c in self.names])
        return CleaningPlan([ColumnPlan(c, [] if c in few else self.steps[c]) for c in self.names]).apply(rows)

    def _collapse(self) -> None:
        """Remove duplicates and list the distinct values, each once, on shared storage.

        The copies counter still tells the raw counts. All later passes read only the distinct values. Whole
        numbers without gaps need no list unless outliers are sought: a few counts are all that is asked of them.
        """
        if self.config.remove_duplicates:
            self.rows = stage(collapse_duplicates(self.source), "distinct-rows", small_tasks=True)
            weighted, weight = self.rows, COPIES
        else:
            self.rows = self.source
            weighted, weight = self.source.withColumn(COPIES, F.lit(1)), COPIES
        self.scalars = [c for c in self.names if schema.is_scalar(self.kinds[c])]
        self.counted = self._count_whole_columns(weighted)
        self.scalars = [c for c in self.scalars if c not in self.counted]
        freq = frequency.value_frequencies(weighted, self.scalars, keep_missing=True, weight=weight)
        self.values = stage(freq, "values", small_tasks=True)

    def _count_whole_columns(self, weighted: DataFrame) -> dict[str, dict]:
        """Counts of the columns of whole numbers that have no gaps, if some column with a list of values is left."""
        whole = [c for c in self.scalars if isinstance(self.kinds[c], T.IntegralType)]
        if self.config.outlier_strategy != "flag_only" or len(whole) == len(self.scalars):
            return {}

        def measures(name: str) -> dict[str, Column]:
            return {
                "rows": F.count(F.lit(1)), "raw_rows": F.sum(COPIES), "present": F.count(schema.col(name)),
                "negatives": F.count_if(schema.col(name) < 0) if self._must_be_positive(name) else F.lit(0),
            }

        found = measure_columns(weighted, whole, measures)
        return {c: {**f, "raw_missing": 0} for c, f in found.items() if f["rows"] and f["rows"] == f["present"]}

    def _value(self, name: str) -> tuple[Column, T.DataType]:
        """A column of the rows after the steps decided so far."""
        return run_steps(schema.col(name), self.kinds[name], self.steps[name])

    def _current(self) -> DataFrame:
        """The distinct values after the steps decided so far; columns treated alike share an expression."""
        alike: dict[tuple[str, str], list[str]] = defaultdict(list)
        for c in self.scalars:
            alike[self.kinds[c].simpleString(), json.dumps(self.steps[c])].append(c)
        slots = {slot: F.when(F.lit(False), F.lit(None)) for slot in ("whole", "number", "text")}
        for members in alike.values():
            kind = self.kinds[members[0]]
            value, kind = run_steps(_typed(kind), kind, self.steps[members[0]])
            here = F.col("column_name").isin(*members)
            if isinstance(kind, T.IntegralType):
                slots["whole"] = slots["whole"].when(here, value.cast("bigint"))
            elif schema.is_number(kind):
                slots["number"] = slots["number"].when(here, value.cast("double"))
            if not isinstance(kind, T.IntegralType) and not schema.is_float(kind):
                slots["text"] = slots["text"].when(here, value.cast("string"))
        return self.values.select("column_name", *[c.alias(slot) for slot, c in slots.items()], "n")

    def _first_pass(self) -> None:
        """Count per column what the text steps, the sign fix and the date parser would do."""
        spaced: list[str] = []
        renamed: dict[str, list[str]] = defaultdict(list)
        for c in self.scalars:
            if self._is_cleanable_text(c):
                for step in self._text_steps(c):
                    if step["step"] == "squeeze":
                        spaced.append(c)
                    else:
                        renamed[json.dumps(step)].append(c)
        dates = self._date_candidates() if self.config.standardize_dates else []
        timed = [c for c in dates if schema.is_temporal(self.kinds[c])]
        positive = [c for c in self.scalars if schema.is_number(self.kinds[c]) and self._must_be_positive(c)]

        name, n, raw = F.col("column_name"), F.col("n"), F.col("text")
        squeezed = F.when(name.isin(*spaced), run_step(raw, T.StringType(), {"step": "squeeze"})[0]).otherwise(raw)
        termed = F.col("squeezed")
        for step, members in renamed.items():
            termed = F.when(name.isin(*members), run_step(F.col("squeezed"), T.StringType(), json.loads(step))[0]).otherwise(termed)
        day = F.when(name.isin(*timed), raw.try_cast("date")).when(
            name.isin(*dates), parse_date(raw, T.StringType(), self.config.date_formats)
        )
        negative = name.isin(*positive) & (F.coalesce("number", F.col("whole").cast("double")) < 0)
        missing = F.coalesce(raw, F.col("number").cast("string"), F.col("whole").cast("string")).isNull()
        read = self.values.withColumn("squeezed", squeezed).select(
            name, n, "weighted", raw, "squeezed", termed.alias("termed"), day.alias("day"),
            negative.alias("negative"), missing.alias("missing"),
        )

        def occurrences(condition: Column, of: Column = n) -> Column:
            return F.sum(F.when(condition, of).otherwise(0))

        # copies of a spelling meet first, which also counts the spellings left after these steps
        sums = {
            "rows": F.sum(n),
            "raw_rows": F.sum("weighted"),
            "present": occurrences(~F.col("missing")),
            "raw_missing": occurrences(F.col("missing"), F.col("weighted")),
            "changed_squeeze": occurrences(raw != F.col("squeezed")),
            "changed_term": occurrences(F.col("squeezed") != F.col("termed")),
            "negatives": occurrences(F.col("negative")),
            "days": occurrences(F.col("day").isNotNull()),
            "values": F.count_if(~F.col("missing")),
        }
        spellings = read.groupBy("column_name", "termed").agg(*[m.alias(k) for k, m in sums.items()])
        counted = spellings.groupBy("column_name").agg(
            *[F.sum(k).alias(k) for k in sums], F.count("termed").alias("spellings")
        )
        empty = dict.fromkeys((*sums, "spellings"), 0)
        self.found = {c: dict(empty) for c in self.names}
        for line in counted.collect():
            self.found[line["column_name"]] |= line.asDict()
        for name, found in self.counted.items():
            self.found[name] |= found
        self._count_nested()

        sizes = self.found[self.scalars[0]] if self.scalars else self.found[self.names[0]]
        self.total, raw_rows = sizes["rows"], sizes["raw_rows"]
        self.before = {
            "rows": raw_rows,
            "columns": len(self.names),
            "missing": sum(f["raw_missing"] for f in self.found.values()),
            # without removal the duplicates are only counted when a summary asks for them
            "duplicates": raw_rows - self.total if self.config.remove_duplicates else None,
        }

    def _count_nested(self) -> None:
        """Columns with nested types are only looked at for missing values."""
        nested = [c for c in self.names if not schema.is_scalar(self.kinds[c])]
        copies = F.col(COPIES) if self.config.remove_duplicates else F.lit(1)

        def measures(name: str) -> dict[str, Column]:
            return {
                "rows": F.count(F.lit(1)),
                "raw_rows": F.sum(copies),
                "present": F.count(schema.col(name)),
                "raw_missing": F.sum(F.when(schema.col(name).isNull(), copies).otherwise(0)),
            }

        for name, found in measure_columns(self.rows, nested, measures).items():
            self.found[name] |= {k: v or 0 for k, v in found.items()}

    def _decide_text_signs_and_dates(self) -> None:
        limit = max(CASING_FLOOR, int(self.total * CASING_SHARE))
        self.recased = set()
        for name in [*self.scalars, *self.counted]:
            found = self.found[name]
            if self._is_cleanable_text(name) and found["present"]:
                for step in self._text_steps(name):
                    counter = "changed_squeeze" if step["step"] == "squeeze" else "changed_term"
                    if self.keep_idle or found[counter]:
                        self.steps[name].append(step)
                if self._may_recase(name) and found["spellings"] < limit:
                    self.recased.add(name)
            if schema.is_number(self.kinds[name]) and self._must_be_positive(name):
                if self.keep_idle or found["negatives"]:
                    self.steps[name].append({"step": "abs"})
            if found["days"] and found["days"] / found["present"] >= DATE_SHARE:
                target = None if self.config.as_date else self.config.target_date_format
                self.steps[name].append(
                    {"step": "date", "format": target, "formats": list(self.config.date_formats)}
                )

    def _quantiles(self, names: list[str], points: tuple[float, ...]) -> dict[str, list[float]]:
        return value_quantiles(self._current(), names, points) if names else {}

    def _fit_outliers(self) -> None:
        self.fences, self.centers = {}, {}
        if self.config.outlier_strategy == "flag_only":
            return
        numbers = [
            c
            for c in self.scalars
            if schema.is_number(self.kinds[c]) and self.found[c]["present"] > OUTLIER_MINIMUM
        ]
        quartiles = self._quantiles(numbers, (0.25, 0.5, 0.75))
        self.fences = iqr_fences(quartiles)
        self.centers = {c: q[1] for c, q in quartiles.items()}

    def _outlier_step(self, name: str) -> Step:
        low, high = self.fences[name]
        if self.config.outlier_strategy == "cap_iqr":
            return {"step": "clip", "low": low, "high": high}
        return {"step": "replace", "low": low, "high": high, "value": self.centers[name]}

    def _second_pass(self) -> None:
        """Count casing changes and outliers, then look at the values as they are after both."""
        if not self.scalars:
            return
        name, n, text = F.col("column_name"), F.col("n"), F.col("text")
        case = {"step": "case", "style": self.config.casing_strategy}
        cased = F.when(name.isin(*self.recased), run_step(text, T.StringType(), case)[0]).otherwise(text)
        x = F.coalesce("number", F.col("whole").cast("double"))
        beyond, treated = F.lit(False), x
        if self.fences:
            bounds = {c: (*self.fences[c], self.centers[c]) for c in self.fences}
            low, high, center = (per_column_constants(bounds)[i] for i in range(3))
            beyond = F.coalesce(outside(x, low, high), F.lit(False))
            capped = F.greatest(F.least(x, high), low)
            treated = F.when(beyond, capped if self.config.outlier_strategy == "cap_iqr" else center).otherwise(x)
        read = self._current().select(
            name, n, text, cased.alias("cased"), beyond.alias("beyond"), treated.alias("x")
        ).withColumn("spelled", F.coalesce("x", to_number(F.col("cased"), T.StringType())))
        present = F.coalesce("cased", F.col("x").cast("string")).isNotNull()
        counted = read.groupBy("column_name").agg(
            F.sum(F.when(text != F.col("cased"), n).otherwise(0)).alias("changed_case"),
            F.sum(F.when(F.col("beyond"), n).otherwise(0)).alias("outliers"),
            F.try_divide(F.sum(F.col("x") * n), F.sum(F.when(F.col("x").isNotNull(), n))).alias("mean"),
            F.bool_and(F.when(present, F.col("spelled").isNotNull())).alias("all_numbers"),
            F.bool_and(is_whole(F.col("spelled"))).alias("all_whole"),
        )
        for line in counted.collect():
            self.found[line["column_name"]] |= line.asDict()
        for c in self.scalars:
            if c in self.recased and (self.keep_idle or self.found[c]["changed_case"]):
                self.steps[c].append(case)
            if self.found[c].get("outliers"):
                self.steps[c].append(self._outlier_step(c))

    def _decide_fills_and_types(self) -> None:
        missing = {}
        for name in self.names:
            found = self.found[name]
            dated = any(s["step"] == "date" for s in self.steps[name])
            missing[name] = self.total - (found["days"] if dated else found["present"])
        wanted = {c: self._rule(c) for c in self.scalars if missing[c]}
        halves = [c for c, r in wanted.items() if r == "median" and self.found[c]["present"]]
        medians = {c: q[0] for c, q in self._quantiles(halves, (0.5,)).items()}
        modes = {}
        usual = [c for c, r in wanted.items() if r == "mode"]
        if usual:
            present = F.coalesce("text", F.col("number").cast("string"), F.col("whole").cast("string")).isNotNull()
            counts = self._current().where(F.col("column_name").isin(*usual) & present)
            counts = counts.groupBy("column_name", "whole", "number", "text").agg(F.sum("n").alias("n"))
            modes = {r["column_name"]: r["value"] for r in frequency.first_values(counts, 1).collect()}

        self.filled = {}
        for name, rule in wanted.items():
            constant = self._constant(name, rule, medians, modes)
            if constant is not None:
                self.steps[name].append({"step": "fill", "value": constant})
                self.filled[name] = (rule, missing[name], constant)
        self.missing_after = sum(missing.values()) - sum(n for _, n, _ in self.filled.values())

        self.typed = {}
        if self.config.auto_convert_types:
            for name in self.scalars:
                target = self._target_type(name)
                if target:
                    self.typed[name] = (self._value(name)[1].simpleString(), target)
                    self.steps[name].append({"step": "cast", "to": target})

    def _constant(self, name: str, rule: str, medians: dict, modes: dict):
        """What to put in place of a missing value; None leaves it missing."""
        kind = self._value(name)[1]
        if rule == "leave_unchanged":
            return None
        if schema.is_number(kind):
            by_rule = {
                "median": medians.get(name),
                "mean": self.found[name]["mean"],
                "mode": float(modes[name]) if name in modes else 0,
                "zero": 0,
            }
            constant = by_rule[rule]
            if constant is not None and isinstance(kind, T.IntegralType) and float(constant).is_integer():
                return int(modes[name]) if rule == "mode" and name in modes else int(constant)
            return constant
        if schema.is_temporal(kind):
            return modes.get(name) if rule == "mode" else None
        if schema.is_boolean(kind) and name in modes:
            return modes[name] == "true"
        return modes.get(name, UNKNOWN) if rule == "mode" else UNKNOWN

    def _target_type(self, name: str) -> str | None:
        """BIGINT or DOUBLE when every value, fill included, allows it."""
        kind = self._value(name)[1]
        found = self.found[name]
        fill = self.filled[name][2] if name in self.filled else None
        if schema.is_float(kind):
            values_whole = found.get("all_whole")
            if values_whole is False or (values_whole is None and fill is None):
                return None
            return "bigint" if fill is None or float(fill).is_integer() else None
        if not schema.is_text(kind) or name == self.roles.email or not found.get("all_numbers"):
            return None
        if any(part in name.lower() for part in UNTYPED_NAMES):
            return None
        if fill is not None and fill == UNKNOWN:
            return None
        return "bigint" if found["all_whole"] else "double"

    # ---- the account --------------------------------------------------------------------------

    def _ordered_audit(self) -> list[AuditEntry]:
        """One entry per step that changed something, in the order the steps run."""
        log: list[AuditEntry] = []

        def note(operation: str, column: str, affected: int, description: str) -> None:
            if affected:
                log.append(AuditEntry(operation, column, affected, description))

        if self.names != self.original_headers:
            note(
                "Column Header Standardization", "All Headers", len(self.names),
                "Trimmed leading/trailing whitespaces from column names",
            )
        removed = self.before["rows"] - self.total
        if removed:
            note(
                "Duplicate Removal", "All Columns", removed,
                f"Removed {removed} duplicate rows (retained {self.config.duplicate_keep_strategy} instance)",
            )
        for name in self.names:
            for step in self.steps[name]:
                if step["step"] in _TEXT_NOTES:
                    n = self.found[name][_COUNTERS[step["step"]]]
                    operation, description = _TEXT_NOTES[step["step"]]
                    note(operation, name, n, description.format(n=n, style=step.get("style", "").capitalize()))
        for name in self.names:
            for step in self.steps[name]:
                if step["step"] == "abs":
                    n = self.found[name]["negatives"]
                    note(
                        "Negative Value Correction", name, n,
                        f"Converted {n} negative entries into valid positive magnitudes using absolute value",
                    )
                elif step["step"] == "clip":
                    n = self.found[name]["outliers"]
                    note(
                        "Outlier Winsorization", name, n,
                        f"Capped {n} extreme statistical outliers to IQR bounds [{step['low']:.2f}, {step['high']:.2f}]",
                    )
                elif step["step"] == "replace":
                    n = self.found[name]["outliers"]
                    note(
                        "Outlier Median Imputation", name, n,
                        f"Replaced {n} extreme outliers with column median ({step['value']:.2f})",
                    )
        for name in self._date_candidates():
            if any(s["step"] == "date" for s in self.steps[name]):
                days, lost = self.found[name]["days"], self.found[name]["present"] - self.found[name]["days"]
                description = f"Standardized {days} dates to format '{self.config.target_date_format}'"
                if lost:
                    description += f"; {lost} unparseable entries coerced to null"
                note("Date Standardization", name, days, description)
        for name in self.names:
            if name in self.filled:
                rule, n, constant = self.filled[name]
                note("Missing Value Imputation", name, n, _fill_note(rule, n, constant))
        for name, (source, target) in self.typed.items():
            if source == "string":
                description = f"Cast text-formatted numbers to {target}"
            else:
                description = f"Converted from {source} to Integer ({target})"
            note("Data Type Conversion", name, self.total, description)
        return log


# Which count of the fit tells how many rows a text step changed.
_COUNTERS = {
    "squeeze": "changed_squeeze", "email": "changed_term", "synonyms": "changed_term", "case": "changed_case",
}
# Operation name and description of the text steps.
_TEXT_NOTES = {
    "squeeze": (
        "Whitespace Normalization",
        "Trimmed leading/trailing whitespaces and collapsed double spaces in {n} rows",
    ),
    "email": ("Email Standardization", "Normalized email casing to lowercase for {n} records"),
    "synonyms": (
        "Categorical Synonym Standardization",
        "Mapped inconsistent representations (e.g. COD/wire/credit_card) to canonical terms ({n} rows)",
    ),
    "case": ("Text Casing Normalization", "Standardized text casing to {style} for {n} records"),
}


def _fill_note(rule: str, n: int, constant) -> str:
    if rule == "zero":
        return f"Filled {n} missing entries with constant 0"
    if rule == "unknown":
        return f"Imputed {n} missing entries with category '{UNKNOWN}'"
    if rule == "mode" and isinstance(constant, str):
        return f"Imputed {n} missing entries using most frequent category Mode ('{constant}')"
    if rule == "mode":
        return f"Imputed {n} missing entries using column Mode ({constant})"
    return f"Imputed {n} missing entries using column {rule.capitalize()} ({constant:.2f})"
