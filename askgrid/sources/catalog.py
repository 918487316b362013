"""Tables by any name, kept as Parquet, with their metadata as entity-attribute-value rows."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askgrid.functions.text import SPARK_TYPES, sample_text, sql_type
from askgrid.plans.rewrite import FOLDED
from askgrid.sources.staging import delete, written

EAV = "entity string, attribute string, value string"
HIDDEN, LOG = "tables_metadata", "_log"
#: What the lower-case companions of text columns begin with.
LOW = "_ag_low_"
MODES = ("replace", "append", "fail")
#: Times that metadata are merged anew with what another writer has written meanwhile.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer was faster; nothing was changed."""


def upserted(old: DataFrame | None, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Old rows with new ones in the place of those with equal keys; of several new ones the last by value stays."""
    keys = keys or ["entity", "attribute"]
    rows = new.withColumn("_v", F.lit(1))
    rows = rows if old is None else rows.unionByName(old.withColumn("_v", F.lit(0)))
    latest = Window.partitionBy(*keys).orderBy(F.desc("_v"), F.desc("value"))
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_v")


def pivoted(eav: DataFrame, attributes: list[str], entity: str = "entity") -> DataFrame:
    """One row for each entity; named attributes, so no pass is spent on finding them."""
    return eav.where(F.col("attribute").isin(attributes)).groupBy(entity).pivot("attribute", attributes).agg(F.max("value"))


def column_groups(eav: DataFrame) -> DataFrame:
    """(group, columns): columns by their group number, in order; other numbers are left out."""
    groups = eav.where("attribute = 'group'").select("entity", F.expr("try_cast(value AS int)").alias("group")).where("group is not null")
    return groups.groupBy("group").agg(F.array_sort(F.collect_list("entity")).alias("columns")).orderBy("group")


def collapsed_columns(columns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Names that differ in case alone become their first spelling; a type other than string wins."""
    out: dict[str, list[str]] = {}
    for name, kind in columns:
        own = out.setdefault(name.lower(), [name, kind])
        if own[1] == "string" and kind != "string":
            own[1] = kind
    return [(n, k) for n, k in out.values()]


def without_twins(table: DataFrame) -> DataFrame:
    """``table`` with columns whose names differ in case alone as one: the first spelling, and the first column that isn't text."""
    pairs = list(table.dtypes)
    if len({c.lower() for c, _ in pairs}) == len(pairs):
        return table
    numbered, out = table.toDF(*[f"_ag_{k}" for k in range(len(pairs))]), []
    for name, _ in collapsed_columns(pairs):
        own = [k for k, (c, _) in enumerate(pairs) if c.lower() == name.lower()]
        out.append(F.col(f"_ag_{next((k for k in own if pairs[k][1] != 'string'), own[0])}").alias(name))
    return numbered.select(*out)


def joined_lists(table: DataFrame) -> DataFrame:
    """List columns as texts."""
    return table.withColumns({c: F.array_join(F.col(f"`{c}`").cast("array<string>"), "; ") for c, t in table.dtypes if t.startswith("array")})


class TableCatalog:
    """Tables under one folder; each is a temporary view by its own name, whatever characters that has.

    A new catalog over the folder finds the tables, their metadata and their value indexes again.
    A table's folder holds a folder of rows for each write and a log of versions: a version names the
    folders that it consists of, and comes to be by the renaming of one file, which fails where there
    is one of that number. So a reader sees a version whole and goes on seeing it, a crash leaves at
    most rows that no version names (``vacuum`` deletes them), and of two writers that saw the same
    version one raises Conflict.
    """

    def __init__(self, spark: SparkSession, folder: str, include: list[str] | None = None, ignore: list[str] | None = None):
        if include and ignore:
            raise ValueError("either include or ignore, not both")
        self.spark, self.folder, self.include, self.ignore = spark, folder, include, set(ignore or [])
        self.tables: dict[str, DataFrame] = {}
        self.folded: dict[str, dict[str, str]] = {}
        for name, parts in self._found().items():
            self.register(name, spark.read.parquet(*parts))

    def _path(self, path: str):
        own = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(self.spark._jsc.hadoopConfiguration()), own

    def _listed(self, path: str) -> list[str]:
        files, own = self._path(path)
        return [x.getPath().toString() for x in files.listStatus(own)] if files.exists(own) else []

    def _version(self, root: str) -> tuple[int, str | None, list[str]]:
        """Number, table name and folders of the last version; 0, None and none where there is none."""
        last = max((x for x in self._listed(f"{root}/{LOG}") if x.endswith(".json")), default=None)
        if last is None:
            return 0, None, []
        files, own = self._path(last)
        stream = files.open(own)
        said = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        return int(last.rsplit("/", 1)[1].removesuffix(".json")), said["name"], [f"{root}/{x}" for x in said["parts"]]

    def _commit(self, root: str, number: int, name: str, parts: list[str]) -> None:
        """Make a version, or raise Conflict where one of that number is there."""
        files, draft = self._path(f"{root}/{LOG}/{uuid.uuid4().hex}.draft")
        stream = files.create(draft, True)
        stream.write(bytearray(json.dumps({"name": name, "parts": [x.rsplit("/", 1)[1] for x in parts]}).encode()))
        stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        keep_old = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        context = hadoop.FileContext.getFileContext(files.makeQualified(draft).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(self._path(f"{root}/{LOG}/{number:020d}.json")[1]), keep_old)
        except Py4JJavaError as e:
            files.delete(draft, False)
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            raise Conflict(name) from None

    def _found(self) -> dict[str, list[str]]:
        """Folders by name of the tables that the catalog's folder holds."""
        found = (self._version(x) for x in self._listed(self.folder))
        return {name: parts for _, name, parts in found if name is not None}

    def path(self, name: str) -> str:
        """A folder name of plain characters, unlike any other table's."""
        plain = re.sub(r"\W+", "_", name, flags=re.ASCII).strip("_")[:60]
        return f"{self.folder}/{plain}-{hashlib.sha1(name.encode()).hexdigest()[:10]}"

    def register(self, name: str, table: DataFrame) -> DataFrame:
        """Show a table as a view of its name; lower-case companions are in a view of their own."""
        low = [c for c in table.columns if c.startswith(LOW)]
        self.folded.pop(name, None)
        if low:
            table.createOrReplaceTempView(f"`{name}{FOLDED}`")
            self.folded[name] = {c.removeprefix(LOW): c for c in low}
            table = table.drop(*low)
        table.createOrReplaceTempView(f"`{name}`")
        self.tables[name] = table
        return table

    def refresh(self, name: str) -> DataFrame | None:
        """The last version of a table, written by whomever; None where there is none."""
        _, _, parts = self._version(self.path(name))
        return self.register(name, self.spark.read.parquet(*parts)) if parts else None

    def write(self, name: str, table: DataFrame, if_exists: str = "fail", order: list[str] | None = None, least_rows: int = 0, fold: list[str] | None = None) -> DataFrame | None:
        """Write a table and register it; ``order`` gives rows a dense rowid by those columns, after those of the rows there are.

        Tables of fewer than ``least_rows`` rows are left out. Columns whose names differ in case
        alone become one, and lists texts. Rows are appended to a table of the same columns and
        types only; a table that exists raises FileExistsError where ``if_exists`` is fail, and
        Conflict where another writer has written a version since this one began. Text columns that
        ``fold`` names (when appending, those of the table there is) get a lower-case companion with
        a bloom filter, which predicates without regard to case are pushed down to.
        """
        if if_exists not in MODES:
            raise ValueError(f"if_exists is one of {', '.join(MODES)}")
        if least_rows and table.limit(least_rows).count() < least_rows:
            return None
        table, root = joined_lists(without_twins(table)), self.path(name)
        number, _, parts = self._version(root)
        if parts and if_exists == "fail":
            raise FileExistsError(name)
        old = self.spark.read.parquet(*parts) if parts and if_exists == "append" else None
        if order:
            table = dense_rowid(table, order)
        low = [c.removeprefix(LOW) for c in old.columns if c.startswith(LOW)] if old is not None else fold or []
        table = table.withColumns({f"{LOW}{c}": F.lower(F.col(f"`{c}`")) for c in low if c in table.columns})
        if old is not None:
            if dict(old.dtypes) != dict(table.dtypes):
                raise ValueError(f"{name} has other columns: {sorted(set(old.dtypes) ^ set(table.dtypes))}")
            if order:
                last = old.agg(F.max("rowid")).first()[0] or 0
                table = table.withColumn("rowid", F.col("rowid") + last)
            table = table.select(*[F.col(f"`{c}`") for c in old.columns])
        rows = f"{root}/rows-{uuid.uuid4().hex}"
        writer = table.write.option("parquet.compression", "zstd")
        for c in low:
            writer = writer.option(f"parquet.bloom.filter.enabled#{LOW}{c}", "true")
        writer.parquet(rows)
        try:
            self._commit(root, number + 1, name, [*parts, rows] if old is not None else [rows])
        except Conflict:
            delete(self.spark, rows)
            raise
        return self.refresh(name)

    def compact(self, name: str) -> DataFrame | None:
        """The rows of all writes in one folder; Conflict where the table is being written."""
        root = self.path(name)
        number, _, parts = self._version(root)
        if len(parts) > 1:
            rows = f"{root}/rows-{uuid.uuid4().hex}"
            self.spark.read.parquet(*parts).write.option("parquet.compression", "zstd").parquet(rows)
            self._commit(root, number + 1, name, [rows])
        return self.refresh(name)

    def vacuum(self, name: str) -> None:
        """Delete what the last version doesn't name: once no reader of an older one is left, and no writer is at work."""
        root = self.path(name)
        number, _, parts = self._version(root)
        named = {x.rsplit("/", 1)[1] for x in parts} | {LOG}
        for x in self._listed(root):
            if x.rsplit("/", 1)[1] not in named:
                delete(self.spark, x)
        for x in self._listed(f"{root}/{LOG}"):
            if not x.endswith(f"{number:020d}.json"):
                delete(self.spark, x)

    def names(self) -> list[str]:
        """Usable tables, sorted; metadata and indexes stay hidden."""
        known = {n for n in self.tables if n != HIDDEN and not n.endswith(("__metadata", "__index"))}
        if missing := (set(self.include or []) | self.ignore) - known:
            raise ValueError(f"no such tables: {sorted(missing)}")
        return sorted(known & set(self.include) if self.include else known - self.ignore)

    def schema(self) -> dict[str, dict[str, str]]:
        return {n: {c: t for c, t in self.tables[n].dtypes if t != "void"} for n in self.names()}

    def _upsert(self, name: str, rows: DataFrame, if_exists: str) -> DataFrame:
        """Merge metadata with the last version of them, and again where another writer was faster."""
        own = rows.select("entity", "attribute", "value")
        for _ in range(TRIES):
            old = self.refresh(name)
            if old is not None and if_exists == "fail":
                raise FileExistsError(name)
            try:
                return self.write(name, upserted(old if if_exists == "append" else None, own), "replace")
            except Conflict:
                continue
        raise Conflict(name)

    def describe(self, table: str, rows: DataFrame, if_exists: str = "append") -> DataFrame:
        """Upsert column metadata (entity, attribute, value) of a table."""
        return self._upsert(f"{table}__metadata", rows, if_exists)

    def describe_tables(self, rows: DataFrame, if_exists: str = "append") -> DataFrame:
        """Upsert metadata (entity, attribute, value) of tables: their summaries and kinds of source."""
        return self._upsert(HIDDEN, rows, if_exists)

    def write_index(self, table: str, index: DataFrame, if_exists: str = "replace") -> DataFrame:
        """Keep a table's value index (table_name, column_name, value, embedding)."""
        flat = index.withColumn("embedding", F.col("embedding").cast("array<float>").cast("string"))
        return self.write(f"{table}__index", flat, if_exists)

    def index(self, tables: list[str] | None = None) -> DataFrame | None:
        """The value indexes of the tables, or of all, as one; rows without a value or a whole vector are left out."""
        found = [t for n, t in sorted(self.tables.items()) if n.endswith("__index") and (tables is None or n.removesuffix("__index") in tables)]
        if not found:
            return None
        rows = reduce(DataFrame.unionByName, found).withColumn("embedding", F.from_json(F.col("embedding"), "array<float>"))
        return rows.where("value is not null and embedding is not null and not exists(embedding, x -> x is null)")

    def ddl(self, table: str, columns: list[str] | None = None, samples: dict[str, list] | None = None, comments: bool = False) -> str:
        """CREATE TABLE text of a table, with sample values and, on request, column descriptions."""
        notes: dict[str, str] = {}
        if comments and f"{table}__metadata" in self.tables:
            notes = {r["entity"]: r["value"] for r in self.tables[f"{table}__metadata"].where("attribute = 'description'").collect()}
        kinds = {"string": "TEXT", "bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "INTEGER"}
        lines = []
        for c, t in sorted(self.tables[table].dtypes):
            if t == "void" or columns is not None and c not in columns:
                continue
            shown = [v if isinstance(v, str) and v[:1] == v[-1:] == '"' else f'"{v}"' if isinstance(v, str) else str(v) for v in (samples or {}).get(c, [])]
            extra = [*([notes[c]] if c in notes else []), *([f"Sample values: {', '.join(shown)}"] if shown else [])]
            lines.append(f'  "{c}" {kinds.get(t, "TEXT")}' + (f" -- {'; '.join(extra)}" if extra else ""))
        return f'CREATE TABLE "{table}" (\n' + ",\n".join(lines) + "\n)"


def dense_rowid(table: DataFrame, order: list[str]) -> DataFrame:
    """``table`` with rowid 1, 2, 3 ... in order, without gathering it in one task.

    Ranges of ``order`` (ties spread by a hash of the row) are sorted and written once, each row
    with its task and its place there; counting and numbering read that one table, so both see the
    same ranges. A range's offset is the count of all before it: one row a range is broadcast.
    """
    plain = [F.col(f"`{c}`") for c, t in table.dtypes if "map<" not in t and t not in ("variant", "void")]
    keys = [F.col(f"`{c}`") for c in order] + ([F.xxhash64(*plain)] if plain else [])
    dealt = table.repartitionByRange(*keys).sortWithinPartitions(*keys)
    staged = written(dealt.withColumn("_ag_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_ag_at", 33), F.col("_ag_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = staged.groupBy(part.alias("_ag_part")).agg(F.count("*").alias("_ag_c"))
    before = Window.orderBy("_ag_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = counts.select("_ag_part", F.coalesce(F.sum("_ag_c").over(before), F.lit(0)).alias("_ag_start"))
    numbered = staged.withColumn("_ag_part", part).join(F.broadcast(starts), "_ag_part")
    return numbered.select(*[F.col(f"`{c}`") for c in table.columns if c != "rowid"], (F.col("_ag_start") + place + 1).alias("rowid"))


def samples(table: DataFrame, column: str, budget: int = 1000) -> DataFrame:
    """(value): distinct values in order, until their texts reach the budget; the last may pass it.

    A value takes at least a character, so budget + 1 values are enough to look at.
    """
    kind = dict(table.dtypes)[column]
    own = F.round(F.col(f"`{column}`"), 2) if kind in ("double", "float") else F.col(f"`{column}`")
    some = table.where(own.isNotNull()).select(own.alias("value")).distinct().orderBy("value").limit(budget + 1)
    used = F.coalesce(F.sum(F.greatest(F.lit(1), F.char_length(F.col("value").cast("string")))).over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return some.withColumn("_used", used).where(F.col("_used") < budget).select(F.col("value"), sample_text(F.col("value"), kind == "string").alias("shown"))


def empty_like(spark: SparkSession, properties: dict[str, str]) -> DataFrame:
    """An empty table of JSON-typed columns, as the sink stores them."""
    return spark.createDataFrame([], ", ".join(f"`{c}` {SPARK_TYPES[sql_type(t)]}" for c, t in collapsed_columns(list(properties.items()))))
