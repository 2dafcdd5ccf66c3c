"""Writing whole payloads out as files."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from snapfolio.catalog import NESTED_MAP, NESTED_OBJECT, DatasetSpec
from snapfolio.functions import decode_payload, encode_payload, payload_kind
from snapfolio.operators.ranking import DEFAULT_SALTS
from snapfolio.operators.shaping import explode_records, flatten_nested_map
from snapfolio.operators.store import latest_snapshot, nonempty_latest

# Quotes are doubled, so that text with commas, quotes and line ends survives.
# Blanks at either end of a text are part of it.
CSV_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}

#: Characters that Spark writes as %XX in the folder of a partition. Fixed values.
ESCAPED = [chr(c) for c in range(1, 32)] + list("\"#%'*/:=?\\\x7f{[]^")


def select_export_keys(df: DataFrame, keys: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Keep the chosen symbols: all for None, a list, or a DataFrame with ``symbol``.

    A list becomes a filter that reaches the scan. A DataFrame may be of any size: it
    is joined, and Spark picks the join by the sizes it sees at run time.
    """
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        return df.join(keys.select("symbol").distinct(), "symbol", "left_semi")
    return df.filter(F.col("symbol").isin(list(keys)))


def infer_record_type(store: DataFrame, spec: DatasetSpec, how: str = "lookup") -> str:
    """The type of all payload keys of a data type, as found in the newest payloads.

    Runs a job; only the type comes back to the driver. Keys of the catalogue keep
    their declared type and come first, other keys follow by name.
    """
    if spec.shape == NESTED_MAP:
        return spec.record_ddl
    latest = nonempty_latest(store, spec.data_type, how)
    records = decode_payload(F.col("raw_data"), "ARRAY<VARIANT>")
    if spec.shape == NESTED_OBJECT:
        value = decode_payload(F.col("raw_data"), f"STRUCT<`{spec.member}`: VARIANT>")[spec.member]
        variants = latest.select(value.alias("v"))
    else:
        arrays = latest.filter(payload_kind(F.col("raw_data")) == "array")
        variants = arrays.select(F.explode(records).alias("v"))
    found = variants.agg(F.schema_of_variant_agg("v").alias("ddl")).first()["ddl"]
    declared = {f.key: f"`{f.key}`: {f.sql_type}" for f in spec.fields}
    extras: list[str] = []
    if found and found.startswith("OBJECT<"):
        # Only what stands where a type does, not keys that contain these words.
        ddl = re.sub(r"(^|: |ARRAY<)OBJECT<", r"\1STRUCT<", found)
        ddl = re.sub(r"(: |ARRAY<)(VOID|VARIANT)(?=[,>])", r"\1STRING", ddl)
        struct = T.DataType.fromDDL(ddl)
        extras = [
            f"`{f.name.replace('`', '``')}`: {f.dataType.simpleString()}"
            for f in struct.fields
            if f.name not in declared
        ]
    return "STRUCT<" + ", ".join([*declared.values(), *extras]) + ">"


def _whole_records(latest: DataFrame, spec: DatasetSpec, *keep: str) -> DataFrame:
    """``symbol, _records`` and the columns to ``keep``: of each record the texts of its keys (``own``) and, for a nested object,
    those of the other members of the payload (``beside``). Keys differ by case."""
    raw, texts = F.col("raw_data"), "MAP<STRING, STRING>"
    none = F.lit(None).cast("map<string,string>")
    if spec.shape == NESTED_OBJECT:
        decoded = latest.select(
            "symbol", *keep, F.when(payload_kind(raw) == "object", decode_payload(raw, texts)).alias("_payload")
        )
        own = decode_payload(F.try_element_at("_payload", F.lit(spec.member)), texts)
        beside = F.map_filter("_payload", lambda k, _: k != spec.member)
        records = F.when(F.size(own) > 0, F.array(F.struct(own.alias("own"), beside.alias("beside"))))
        return decoded.select("symbol", *keep, records.alias("_records"))
    maps = F.when(payload_kind(raw) == "array", decode_payload(raw, f"ARRAY<{texts}>"))
    return latest.select(
        "symbol", *keep, F.transform(maps, lambda m: F.struct(m.alias("own"), none.alias("beside"))).alias("_records")
    )


#: Kinds of JSON values as bits, so that the kinds of a key are one number. Null has none.
BOOLEAN, WHOLE, NUMBER, TEXT = 1, 2, 4, 8


def _kind(value: Column) -> Column:
    """The kind of a JSON value. Whole numbers beyond a long are text, since no number would hold them."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "VOID", 0)
        .when(name == "BOOLEAN", BOOLEAN)
        .when(name == "BIGINT", WHOLE)
        .when(name.rlike(r"^(DOUBLE|FLOAT|DECIMAL\([0-9]+,[1-9][0-9]*\))$"), NUMBER)
        .otherwise(TEXT)
    )


def type_of_kinds(kinds: int) -> str:
    """The narrowest type that holds values of all these kinds; text if they have nothing in common."""
    if kinds == BOOLEAN:
        return "BOOLEAN"
    if kinds == WHOLE:
        return "BIGINT"
    return "DOUBLE" if kinds in (NUMBER, NUMBER | WHOLE) else "STRING"


def _found_types(latest: DataFrame, spec: DatasetSpec, part: str) -> dict[str, str]:
    """The distinct keys of all records that have no declared type, in order, and the type that all values of a key have.

    One job; only names and types come to the driver, as many as columns are made. A payload that has no exact
    VARIANT (one that repeats a key within an object, or is beyond 16 MB) counts as text.
    """
    raw, values = F.col("raw_data"), "MAP<STRING, VARIANT>"
    declared = [f.key for f in spec.fields] if part == "own" else []
    if spec.shape != NESTED_OBJECT:
        typed = decode_payload(raw, f"ARRAY<{values}>")
    elif part == "own":
        typed = F.array(decode_payload(raw, f"STRUCT<`{spec.member}`: {values}>")[spec.member])
    else:
        typed = F.array(decode_payload(raw, values))

    def others(record: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.coalesce(F.filter(F.map_keys(record[part]), lambda k: ~k.isin(declared)), none)

    # The texts tell which keys there are, the variants of what kind; one record is one place in both. Payloads are
    # only decoded again if they have other keys than declared ones.
    texts = _whole_records(latest, spec, "raw_data").withColumn(
        "_typed", F.when(F.exists("_records", lambda r: F.size(others(r)) > 0), typed)
    )

    def kinds(record: Column, at: Column) -> Column:
        known = F.get("_typed", at)
        return F.transform(
            others(record),
            lambda k: F.struct(
                k.alias("key"), F.coalesce(_kind(F.try_element_at(known, k)), F.lit(TEXT)).alias("kind")
            ),
        )

    entries = F.array_distinct(F.flatten(F.transform("_records", kinds)))
    found = texts.select(F.explode(entries).alias("e")).groupBy("e.key").agg(F.bit_or("e.kind").alias("kinds"))
    return {r["key"]: type_of_kinds(r["kinds"]) for r in sorted(found.collect())}


def column_names(keys: Sequence[str]) -> list[str]:
    """A column name per key. Names are told apart without regard to case, and ``symbol`` and ``pos``
    are taken: a key whose name is taken gets ``_2``, ``_3`` and so on. An empty key is ``_``."""
    taken, names = {"symbol", "pos"}, []
    for key in keys:
        base = name = key or "_"
        n = 1
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        names.append(name)
    return names


def _exploded_whole(latest: DataFrame, spec: DatasetSpec, typed: bool) -> DataFrame:
    records = _whole_records(latest, spec)
    types = {("own", f.key): f.sql_type for f in spec.fields}
    for part in ("own", "beside") if spec.shape == NESTED_OBJECT else ("own",):
        for key, kind in _found_types(latest, spec, part).items():
            types.setdefault((part, key), kind if typed else "STRING")
    names = column_names([k for _, k in types])
    rows = records.select("symbol", F.posexplode("_records").alias("pos", "_r"))
    return rows.select(
        "symbol",
        F.col("pos").cast("long").alias("pos"),
        *[
            F.try_element_at(F.col(f"_r.{part}"), F.lit(key))
            .try_cast(kind)
            .alias(name)
            for ((part, key), kind), name in zip(types.items(), names, strict=True)
        ],
    )


def export_records(
    store: DataFrame,
    spec: DatasetSpec,
    keys: Sequence[str] | DataFrame | None = None,
    record_ddl: str | None = None,
    how: str = "lookup",
    salts: int = DEFAULT_SALTS,
    only_declared: bool = False,
    typed: bool = True,
) -> DataFrame:
    """All records of the newest snapshot of the chosen symbols, with the payload's key
    names, in payload order (``pos``). Keys whose newest snapshot is empty have none.

    All keys of the payloads are exported: the declared ones first, with their types, then the
    others by name, with the narrowest type that holds all their values (JSON text if they are nested or of
    different kinds, all as text without ``typed``), then those of a nested object's other members.
    Names that clash are made different by ``column_names``. Finding the keys runs a job.
    ``record_ddl`` (see ``infer_record_type``) sets keys and types instead, ``only_declared``
    leaves out what the catalogue does not name. Maps of maps become period, segment
    and value, which have no position.
    """
    if isinstance(keys, DataFrame):
        # After the reduction to one row per key, so that no key is hot in the join.
        latest = select_export_keys(latest_snapshot(store, spec.data_type, how, salts), keys)
    else:
        latest = latest_snapshot(select_export_keys(store, keys), spec.data_type, how, salts)
    if spec.shape == NESTED_MAP:
        return flatten_nested_map(latest, spec.member)
    if only_declared or record_ddl is not None:
        return explode_records(latest, spec, record_ddl)
    return _exploded_whole(latest, spec, typed)


def export_path(directory: str, data_type: str, run: str) -> str:
    """Where a run of an export goes; ``run`` is its time stamp ``YYYYmmdd_HHMMSS``."""
    return f"{directory.rstrip('/')}/{data_type}/run={run}"


def folder_name(symbol: Column) -> Column:
    """A symbol as it stands in the name of its folder, ``%`` first."""
    order = sorted(ESCAPED, key=lambda c: c != "%")
    return reduce(lambda s, c: F.replace(s, F.lit(c), F.lit(f"%{ord(c):02X}")), order, symbol)


def export_targets(symbols: DataFrame, spec: DatasetSpec, directory: str, run: str) -> DataFrame:
    """The name of the folder of every symbol within an export by symbol."""
    base = export_path(directory, spec.data_type, run)
    return symbols.select(
        "symbol",
        F.concat("symbol", F.lit(f"_{spec.export_suffix}_{run}")).alias("file_base"),
        F.concat(F.lit(f"{base}/symbol="), folder_name(F.col("symbol"))).alias("target"),
    )


def named_targets(symbols: DataFrame, spec: DatasetSpec, directory: str, run: str, fmt: str = "csv") -> DataFrame:
    """The path of every symbol's file within an export with a file per symbol."""
    base = export_path(directory, spec.data_type, run)
    return symbols.select(
        "symbol", F.concat(F.lit(f"{base}/"), file_name(F.col("symbol"), spec, run, fmt)).alias("target")
    )


def _flat_columns(df: DataFrame) -> DataFrame:
    """CSV holds no arrays, maps or structs: write them as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    named = {f.name: F.col(f"`{f.name.replace('`', '``')}`") for f in df.schema.fields}
    return df.select(
        *[
            encode_payload(named[f.name]).alias(f.name) if isinstance(f.dataType, nested) else named[f.name]
            for f in df.schema.fields
        ]
    )


def _record_order(records: DataFrame) -> list[Column]:
    if "pos" in records.columns:
        return [F.asc("pos")]
    return [F.desc("period"), F.asc("segment")]


def _spread(records: DataFrame) -> DataFrame:
    """Symbols over all shuffle partitions, which AQE would merge by their few bytes: the cost is the number of files."""
    partitions = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By a hash of the symbol: Spark would drop a repartitioning it finds already done,
    # and then merge partitions.
    return records.repartition(partitions, F.xxhash64("symbol"))


def write_export(
    records: DataFrame,
    path: str,
    fmt: str = "csv",
    layout: str = "flat",
    max_records_per_file: int = 1_000_000,
) -> None:
    """Write records as CSV (with header) or Parquet.

    ``layout="symbol"`` makes a folder and file per symbol; its cost is the number of
    files, so the symbols are spread over all shuffle partitions. Their tasks put the files in place, in a folder beside
    ``path`` that gets its name by one rename: the export is there as a whole or not at all. CSV files are written as
    ``write_named_files`` does and entered in ``_files``, those of other formats by Spark's writer, which takes several times as
    long for a file. ``layout="flat"`` keeps
    ``symbol`` as a column, shuffles nothing and is the one to use for very many symbols. The rows of a symbol come
    from one payload, hence one task, and are written in payload order.
    """
    if layout not in ("flat", "symbol"):  # "file" is ``write_named_files``
        raise ValueError(f"unknown layout {layout!r}")

    def save(rows: DataFrame, to: str, *by: str) -> None:
        rows = rows.sortWithinPartitions(F.asc("symbol"), *_record_order(rows))
        writer = (
            rows.write.mode("errorifexists")
            .option("maxRecordsPerFile", max_records_per_file)
            # Otherwise the driver alone moves all files once the tasks are done.
            .options(**({"mapreduce.fileoutputcommitter.algorithm.version": "2"} if by else {}))
            .options(**(CSV_OPTIONS if fmt == "csv" else {}))
            .format(fmt)
        )
        (writer.partitionBy(*by) if by else writer).save(to)

    if layout == "flat":
        save(_flat_columns(records) if fmt == "csv" else records, path)
        return
    fs, target = _hadoop_path(records.sparkSession, path)
    if fs.exists(target):
        raise ValueError(f"{path} already exists")
    _, staged = _hadoop_path(records.sparkSession, f"{target.getParent()}/_staged-{uuid.uuid4().hex}")
    try:
        if fmt == "csv":
            # An empty symbol is in the folder of null, as partitions are.
            named = records.withColumn("symbol", F.coalesce(F.nullif("symbol", F.lit("")), F.lit(NO_SYMBOL)))
            name = F.concat(F.lit("symbol="), folder_name(F.col("symbol")), F.lit("/part"))
            _write_files(named, str(staged), F.col("symbol"), name, fmt, max_records_per_file)
            fs.create(records.sparkSession._jvm.org.apache.hadoop.fs.Path(staged, "_SUCCESS")).close()
        else:
            save(_spread(records), str(staged), "symbol")
        if fs.exists(target) or not fs.rename(staged, target):
            raise OSError(f"cannot name {path}, or it already exists")
    finally:
        fs.delete(staged, True)


def export_csv(records: DataFrame, path: str, **options) -> None:
    write_export(records, path, fmt="csv", **options)


def export_all_keys(
    store: DataFrame,
    spec: DatasetSpec,
    directory: str,
    run: str,
    keys: Sequence[str] | DataFrame | None = None,
    fmt: str = "csv",
    layout: str = "symbol",
    record_ddl: str | None = None,
    how: str = "lookup",
    salts: int = DEFAULT_SALTS,
    only_declared: bool = False,
) -> str:
    """Export the chosen symbols of a data type in one write; returns the folder written. With ``layout="file"``
    each symbol has one file, named as ``export_targets`` says."""
    path = export_path(directory, spec.data_type, run)
    records = export_records(store, spec, keys, record_ddl, how, salts, only_declared)
    if layout == "file":
        write_named_files(records, path, spec, run, fmt)
    else:
        write_export(records, path, fmt=fmt, layout=layout)
    return path


def file_name(symbol: Column, spec: DatasetSpec, run: str, fmt: str = "csv") -> Column:
    """The name of a symbol's file. Characters that names of files cannot have are written as %XX."""
    return F.concat(folder_name(symbol), F.lit(f"_{spec.export_suffix}_{run}.{fmt}"))


FILES_DDL = "symbol STRING, file STRING"
#: What stands for a symbol that is null.
NO_SYMBOL = "__HIVE_DEFAULT_PARTITION__"


def _hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path with its scheme."""
    plain = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = plain.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(plain)


def _file_system(uri: str, folder: str) -> tuple[pa.fs.FileSystem, str]:
    """As the tasks see it. Paths of local folders are taken as they are, without unescaping."""
    return (pa.fs.LocalFileSystem(), folder) if uri.startswith("file:") else pa.fs.FileSystem.from_uri(uri)


def write_named_files(records: DataFrame, path: str, spec: DatasetSpec, run: str, fmt: str = "csv") -> None:
    """One file per symbol, ``{symbol}_{suffix}_{run}.{fmt}``, CSV or Parquet.

    The tasks write the files, each under a name of its own first, and enter them in ``_files``, a table of ``symbol, file`` that
    is whole last: an export without it is not whole. A run that failed can be repeated, and replaces what it left; a whole
    one cannot. The lines of CSV are made by Spark; the driver does nothing per file.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"no files of format {fmt!r}")
    fs, _ = _hadoop_path(records.sparkSession, path)
    _, whole = _hadoop_path(records.sparkSession, f"{path}/_files/_SUCCESS")
    if fs.exists(whole):
        raise ValueError(f"{path} already exists")
    # Every symbol has one name and every name, being reversible, one symbol.
    symbol, name = F.coalesce("symbol", F.lit(NO_SYMBOL)), file_name(F.col("symbol"), spec, run, fmt)
    _write_files(records, path, symbol, F.coalesce(name, F.lit(NO_SYMBOL)), fmt)


def _write_files(
    records: DataFrame, path: str, symbol: Column, name: Column, fmt: str, most: int | None = None
) -> None:
    """A file ``name`` below ``path`` of the rows of every ``symbol``, or files ``{name}-00000.{fmt}`` and so on of ``most``
    rows each, and the table ``_files`` of them."""
    spark = records.sparkSession
    fs, target = _hadoop_path(spark, path)
    _, staged = _hadoop_path(spark, f"{path}/_staged")
    fs.delete(staged, True)
    fs.mkdirs(staged)
    uri, folder = str(target.toUri()), target.toUri().getPath()
    flat = _flat_columns(records) if fmt == "csv" else records
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in flat.columns if c != "symbol"]
    names = [c for c in flat.columns if c != "symbol"]
    header = ""
    if fmt == "csv":
        titles = F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(names)])
        header = spark.range(1).select(F.to_csv(titles, CSV_OPTIONS)).first()[0]
    content = [F.to_csv(F.struct(*columns), CSV_OPTIONS).alias("line")] if fmt == "csv" else columns
    rows = (
        _spread(flat)
        .sortWithinPartitions(F.asc("symbol"), *_record_order(flat))
        .select(symbol.alias("_symbol"), name.alias("_name"), *content)
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(uri, folder)
        # A folder of its own, so that tasks do not wait for each other.
        own = f"{base}/_staged/{uuid.uuid4().hex}"
        system.create_dir(own)

        def runs() -> Iterator[tuple[tuple[str, str], list[str] | pa.RecordBatch]]:
            """The rows of a symbol, in one or more parts that follow one another."""
            for batch in batches:
                at = 0
                keys = zip(batch.column("_symbol").to_pylist(), batch.column("_name").to_pylist(), strict=True)
                plain = batch.drop_columns(["_symbol", "_name"])
                content = plain.column("line").to_pylist() if fmt == "csv" else plain
                for key, same in groupby(keys):
                    n = sum(1 for _ in same)
                    yield key, content[at : at + n]
                    at += n

        def files(parts: Iterator[list[str] | pa.RecordBatch]) -> Iterator[tuple[int, list[str] | pa.RecordBatch]]:
            """The parts of a symbol with the number of their file."""
            n = 0
            for part in parts:
                at = 0
                while at < len(part):
                    end = len(part) if most is None else min(len(part), at + most - n % most)
                    yield 0 if most is None else n // most, part[at:end]
                    n, at = n + end - at, end

        def entered(files: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in files], pa.string()) for k in (0, 1)], names=["symbol", "file"]
            )

        done: list[tuple[str, str]] = []
        for (of, named), parts in groupby(runs(), lambda r: r[0]):
            if "/" in named:
                system.create_dir(f"{base}/{named.rpartition('/')[0]}")
            for number, pieces in groupby(files(p for _, p in parts), lambda f: f[0]):
                file = named if most is None else f"{named}-{number:05d}.{fmt}"
                with system.open_output_stream(f"{own}/file", compression=None) as out:
                    if fmt == "csv":
                        out.write(f"{header}\n".encode())
                        for _, lines in pieces:
                            out.write("".join([f"{line}\n" for line in lines]).encode())
                    else:
                        pa.parquet.write_table(pa.Table.from_batches([piece for _, piece in pieces]), out)
                system.move(f"{own}/file", f"{base}/{file}")
                done.append((of, file))
                if len(done) == 1000:
                    yield entered(done)
                    done = []
        yield entered(done)

    rows.mapInArrow(write, FILES_DDL).write.mode("overwrite").parquet(f"{path}/_files")
    fs.delete(staged, True)


def exported_files(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, file`` of a whole export by ``write_named_files``, or by symbol as CSV."""
    return spark.read.schema(FILES_DDL).parquet(f"{path}/_files")


#: Records of a file that are one row until Spark reads them, and about how many characters are a batch of rows.
RECORDS, BATCH_CHARS = 1000, 4 << 20


def _csv_records(text: Iterable[str]) -> Iterator[str]:
    """The records of lines of CSV; a line end within quotes is part of its record."""
    held: list[str] = []
    odd = False
    for line in text:
        held.append(line)
        odd ^= line.count('"') % 2 == 1
        if not odd:
            record = "".join(held).removesuffix("\n")
            held = []
            if record:
                yield record
    if held:
        yield "".join(held)


def read_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``symbol, file`` and the columns of ``schema``, those of the files in their order, of every record in the CSV files of a whole
    export with files by symbol. The tasks open the files that ``_files`` names, and the driver lists none of them: it would
    otherwise hold each with its size and place. Symbols that are null, and empty ones where folders are named by them, are null."""
    _, target = _hadoop_path(spark, path)
    uri, folder = str(target.toUri()), target.toUri().getPath()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(uri, folder)

        def held(rows: list[tuple[str, str, list[str]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string())))],
                names=["symbol", "file", "lines"],
            )

        rows, chars = [], 0
        for batch in batches:
            for of, file in zip(batch.column("symbol").to_pylist(), batch.column("file").to_pylist(), strict=True):
                with system.open_input_stream(f"{base}/{file}", compression=None) as source:
                    records = _csv_records(io.TextIOWrapper(source, "utf-8", newline="\n"))
                    next(records, None)
                    while lines := list(islice(records, RECORDS)):
                        rows.append((of, file, lines))
                        chars += sum(map(len, lines))
                        if chars > BATCH_CHARS:
                            yield held(rows)
                            rows, chars = [], 0
        yield held(rows)

    # Without a hash in it Spark would merge partitions, by the few bytes of names.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = exported_files(spark, path).repartition(partitions, F.xxhash64("file"))
    lines = files.mapInArrow(read, f"{FILES_DDL}, lines ARRAY<STRING>")
    line = F.from_csv("line", schema, {**CSV_OPTIONS, "lineSep": "\n"})
    rows = lines.select("symbol", "file", F.explode("lines").alias("line")).select("symbol", "file", line.alias("_r"))
    return rows.select(F.nullif("symbol", F.lit(NO_SYMBOL)).alias("symbol"), "file", "_r.*")
