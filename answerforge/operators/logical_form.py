"""Table questions as logical forms {select, aggregate, conditions}, compiled to DataFrame plans.

Dialects differ in comparison and in the result of min and max:

* "text": `=` compares lower-cased strings, `>` and `<` hold only between numbers; an empty result is "";
* "typed": numbers compare as numbers and all else as lists of tokens; min and max pick one row, of
  equal values the last for max and the first for min.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerforge.functions.text import to_number

AGGREGATES = ("select", "max", "min", "count", "sum", "avg")
OPERATORS = ("=", ">", "<")


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: str | float


@dataclass(frozen=True)
class LogicalForm:
    select: str
    aggregate: str = "select"
    conditions: tuple[Condition, ...] = field(default=())

    @classmethod
    def from_indexes(cls, header: list[str], sel: int, agg: int, conds: list[tuple[int, int, str | float]]) -> LogicalForm:
        return cls(header[sel], AGGREGATES[agg], tuple(Condition(header[c], OPERATORS[o], v) for c, o, v in conds))

    def text(self, header: list[str], answer: str) -> str:
        """Serialised with its separators, for a text-to-text model."""
        clean = lambda x: str(x).replace("/", " ")
        conds = " <<cond>> ".join(f"{clean(c.column)} {c.operator} {clean(c.value)}" for c in self.conditions)
        parts = [f"{self.aggregate} {clean(self.select)}", conds, f"<<answer>> {clean(answer)}", "<<header>> " + " <<hsep>> ".join(map(clean, header))]
        return " <<sep>> ".join(p for p in parts if p)


def _numeric(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] in ("int", "bigint", "double", "float", "smallint", "tinyint") or dict(df.dtypes)[name].startswith("decimal")


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(\w+|[^\w\s]+)"), F.lit(1))


def condition_filter(df: DataFrame, c: Condition, dialect: str = "text") -> Column:
    cell = F.col(c.column)
    if _numeric(df, c.column):
        try:
            want = float(str(c.value).replace(",", ""))
        except ValueError:
            return F.lit(False)
        return cell == want if c.operator == "=" else cell > want if c.operator == ">" else cell < want
    if c.operator == "=":
        return F.lower(cell) == str(c.value).lower() if dialect == "text" else _tokens(cell) == _tokens(F.lit(str(c.value)))
    if dialect == "typed":
        return _tokens(cell) > _tokens(F.lit(str(c.value))) if c.operator == ">" else _tokens(cell) < _tokens(F.lit(str(c.value)))
    number, want = to_number(cell), to_number(F.lit(str(c.value)))
    return F.coalesce(number > want if c.operator == ">" else number < want, F.lit(False))


def matching_rows(df: DataFrame, form: LogicalForm, dialect: str = "text") -> DataFrame:
    for c in form.conditions:
        df = df.where(condition_filter(df, c, dialect))
    return df


def execute(df: DataFrame, form: LogicalForm, dialect: str = "text", row_id: str | None = None) -> DataFrame:
    """One column `answer` (plus row_id for the typed min and max)."""
    rows = matching_rows(df, form, dialect)
    cell = F.col(form.select)
    number = cell.cast("double") if _numeric(df, form.select) else to_number(cell)
    if form.aggregate == "select":
        return rows.select(cell.alias("answer"))
    if form.aggregate == "count":
        return rows.agg(F.count("*").alias("answer"))
    if form.aggregate in ("sum", "avg"):
        return rows.agg((F.sum if form.aggregate == "sum" else F.avg)(number).alias("answer"))
    if dialect == "typed" and row_id:
        pick = (F.max if form.aggregate == "max" else F.min)(F.when(number.isNotNull(), F.struct(number.alias("v"), F.col(row_id).alias("r"))))
        return rows.agg(pick.alias("x")).where("x is not null").select(F.col("x.r").alias(row_id), F.col("x.v").alias("answer"))
    return rows.agg((F.max if form.aggregate == "max" else F.min)(number).alias("answer"))


def cells(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(row_id, column, value): every cell of a table as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.col(row_id).alias("row_id"), F.explode(pairs).alias("x")).select("row_id", "x.column", "x.value")


def column_types(cell_rows: DataFrame) -> DataFrame:
    """real where every cell is a number once its commas are gone, else text."""
    number = F.replace("value", F.lit(","), F.lit("")).try_cast("double").isNotNull()
    return cell_rows.groupBy("column").agg(F.when(F.bool_and(F.coalesce(number, F.lit(False))), "real").otherwise("text").alias("type"), F.count("*").alias("cells"))


def value_rows(cell_rows: DataFrame) -> DataFrame:
    """(column, value, row_id): the rows of each value, as a relation."""
    return cell_rows.where("value is not null").select("column", "value", "row_id").distinct()


def inequality_conditions(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(value, operator, rows): how many rows lie below and above each distinct value, where any do.

    Counts come from sums over the sorted distinct values, not from joining every value with every row.
    """
    from answerforge.operators.evaluate import running_totals

    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    run = running_totals(counts, "value", ["n"])
    total = counts.agg(F.sum("n")).first()[0] or 0
    below, above = F.lit(total) - F.col("total_n"), F.col("total_n") - F.col("n")
    each = run.select("value", F.explode(F.array(F.struct(F.lit("<").alias("operator"), below.cast("bigint").alias("rows")), F.struct(F.lit(">").alias("operator"), above.cast("bigint").alias("rows")))).alias("x"))
    return each.select("value", "x.operator", "x.rows").where("rows > 0")


def where_pairs(cell_rows: DataFrame) -> DataFrame:
    """Two-condition clauses (column_a = value_a and column_b = value_b) whose rows are fewer than either
    condition's alone, values with a single row left out. Pairs arise only within a row's own cells."""
    frequent = cell_rows.groupBy("column", "value").agg(F.count("*").alias("n")).where("n > 1")
    kept = cell_rows.join(frequent, ["column", "value"])
    lists = kept.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("column", "value", "n"))).alias("cs"))  # one row's cells
    first = lists.select("cs", F.posexplode("cs").alias("p", "a"))
    pairs = first.select("a", F.explode(F.slice("cs", F.col("p") + 2, F.greatest(F.size("cs"), F.lit(1)))).alias("b"))
    counted = pairs.groupBy(F.col("a.column").alias("column_a"), F.col("a.value").alias("value_a"), F.col("b.column").alias("column_b"), F.col("b.value").alias("value_b")).agg(F.count("*").alias("rows"), F.min(F.least("a.n", "b.n")).alias("least"))
    return counted.where("rows < least").drop("least")
