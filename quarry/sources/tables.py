"""Sources and sinks: pages, JSON lines, multiple-choice files, the chunk store, reports, configuration."""

from __future__ import annotations

import html
import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quarry.functions import text as T

CHUNK_SCHEMA = "chunk_id string, doc_id string, version string, wg string, clause_id string, section_path string, title string, text string, page_start int, page_end int, is_definition int, is_normative int"
EVAL_SCHEMA = "event string, split string, global_i int, question string, options array<string>, gold string, pred_num string, pred_text string, acc double, citations_count int, citations array<struct<chunk_id:string,quote:string>>, shard_id int"


@dataclass(frozen=True)
class Ingest:
    min_chunk_chars: int = 400
    max_chunk_chars: int = 2200
    max_toc_page: int = 30
    max_pages: int | None = None


@dataclass(frozen=True)
class Retrieval:
    bm25_topk: int = 80
    dense_topk: int = 80
    fused_topk: int = 60
    rerank_topk: int = 12
    rrf_k: int = 60
    cap_bm25: int = 80
    cap_dense: int = 80
    weight_bm25: float = 1.0
    weight_dense: float = 1.0


@dataclass(frozen=True)
class Packing:
    max_context_chars: int = 25000
    neighbor_window: int = 1


@dataclass(frozen=True)
class Gate:
    enabled: bool = True  # whether a question that fails is rewritten
    min_score: float = -1.25
    max_rounds: int = 1


@dataclass(frozen=True)
class Generation:
    adapter: str = "stub"
    name: str = ""
    url: str = ""
    max_new_tokens: int = 512
    temperature: float = 0.2
    top_p: float = 0.9


@dataclass(frozen=True)
class Config:
    ingest: Ingest = field(default_factory=Ingest)
    retrieval: Retrieval = field(default_factory=Retrieval)
    packing: Packing = field(default_factory=Packing)
    gate: Gate = field(default_factory=Gate)
    model: Generation = field(default_factory=Generation)
    paths: dict[str, str] = field(default_factory=dict)


def load_config(path: str) -> Config:
    """A YAML file's sections (ingest, retrieval, packing, gate, model, paths) over the defaults; unknown keys are ignored.
    Credentials come from the environment only. Every value acts: segment.corpus takes ingest, ask.Engine all others."""
    import yaml

    with open(path) as f:
        raw = yaml.safe_load(f) or {}
    own = {n: type(d)(**{k: v for k, v in (raw.get(n) or {}).items() if k in asdict(d)}) for n, d in (("ingest", Ingest()), ("retrieval", Retrieval()), ("packing", Packing()), ("gate", Gate()), ("model", Generation()))}
    return Config(**own, paths={k: str(v) for k, v in (raw.get("paths") or {}).items()})


def spread(df: DataFrame) -> DataFrame:
    """df, a scan, dealt over the cores if its files make fewer partitions than there are: a small table in one file is one
    task otherwise. A table of more partitions than cores isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the folder that all executors share; in local mode a temporary one where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quarry-")
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: what reads it several times doesn't compute it several times."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | Ty.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def pdf_pages(spark: SparkSession, folder: str, max_pages: int | None = None) -> DataFrame:
    """file_name, doc_id, page_num, text of the *.pdf files of a folder. Needs a PDF reader on the executors (PyPDF2)."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.pdf")  # an error where there is none

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from PyPDF2 import PdfReader

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = [(path, i, (p.extract_text() or "").replace("\u00a0", " ")) for i, p in enumerate(PdfReader(io.BytesIO(content)).pages[:max_pages], 1)]
                yield pd.DataFrame(rows, columns=["path", "page_num", "text"])

    read = files.select("path", "content").mapInPandas(pages, "path string, page_num int, text string")
    return read.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), T.document_id(F.col("path")).alias("doc_id"), "page_num", "text")


def file_stats(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """files, total_mb, max_mb; only lengths are read."""
    files = spark.read.format("binaryFile").load(f"{folder}/{glob}").select("length")
    mb = lambda c: F.bround(F.coalesce(c, F.lit(0)) / 1e6, 2)
    return files.agg(F.count(F.lit(1)).alias("files"), mb(F.sum("length")).alias("total_mb"), mb(F.max("length")).alias("max_mb"))


def parse_mcq(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with question, options, answer: a JSON array of three or an object, read line by line; rows without question
    or answer go."""
    v = F.try_parse_json(line)
    at = lambda p, t="string": F.try_variant_get(v, p, t)
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    options = F.when(is_list, at("$[1]", "array<string>")).otherwise(F.coalesce(at("$.options", "array<string>"), at("$.choices", "array<string>")))
    lone = F.when(is_list, at("$[1]")).otherwise(F.coalesce(at("$.options"), at("$.choices")))
    question = F.when(is_list, at("$[0]")).otherwise(at("$.question"))
    answer = F.when(is_list, at("$[2]")).otherwise(F.coalesce(at("$.answer"), at("$.label")))
    both = F.coalesce(options, F.when(lone.isNotNull(), F.array(lone)), F.array().cast("array<string>"))
    out = lines.withColumns({"question": T.strip(T.text(question)), "options": F.transform(both, lambda o: T.strip(T.text(o))), "answer": T.strip(T.text(answer))})
    return out.where((F.col("question") != "") & (F.col("answer") != ""))


def read_mcq(spark: SparkSession, path: str) -> DataFrame:
    """question, options, answer of a file of one JSON value a line, or of one JSON list."""
    whole = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("value"))
    one = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    nested = F.size(one) > 0
    # a list of lists or objects is a file of examples; a single example is a list that starts with a string
    examples = nested & F.schema_of_variant(F.get(one, F.lit(0))).rlike("^(ARRAY|OBJECT)")
    rows = whole.select(F.explode(F.when(F.coalesce(examples, F.lit(False)), F.transform(one, lambda x: F.to_json(x))).otherwise(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != ""))).alias("line"))
    return parse_mcq(rows).select("question", "options", "answer")


def read_eval_rows(spark: SparkSession, glob: str) -> DataFrame:
    """Rows of finished answers from shard files: bad lines, heartbeats and rows without split, gold or prediction go."""
    rows = spark.read.schema(EVAL_SCHEMA).option("mode", "DROPMALFORMED").json(glob)
    return rows.where("event is null and split is not null and gold is not null and pred_text is not null")


def upsert(old: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """old with new's rows in the place of those with their key; of several new rows with one key the last by order stays."""
    if order is not None:
        last = F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))
        new = new.withColumn("u_n", last).where("u_n = 1").drop("u_n")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_csv_by_split(rows: DataFrame, path: str) -> None:
    """One folder of CSV a split; nested columns as JSON; in the order of the questions."""
    flat = rows.select("split", "global_i", "question", F.to_json("options").alias("options"), "gold", "pred_num", "pred_text", "acc", F.to_json("citations").alias("citations"))
    # ranges, not one task a split: each file is sorted, and the files of a split follow each other in order
    flat.repartitionByRange("split", "global_i").sortWithinPartitions("split", "global_i").write.mode("overwrite").option("header", True).partitionBy("split").csv(path)


def markdown_report(summary: DataFrame, config: Config, title: str = "Evaluation", files: tuple[str, ...] = ()) -> str:
    """summary: split, n, acc, avg_citations (a row a split); files: what the run wrote."""
    rows = summary.orderBy("split").collect()
    table = "\n".join(f"| {r['split']} | {r['n']} | {r['acc']:.4f} | {r['avg_citations']:.2f} |" for r in rows)
    return f"# {title}\n\n## Settings\n\n```json\n{json.dumps(asdict(config), indent=2)}\n```\n\n## Results\n\n| split | n | accuracy | citations |\n| - | - | - | - |\n{table}\n" + ("\n## Files\n\n" + "\n".join(f"- `{f}`" for f in files) + "\n" if files else "")


def html_report(sections: dict[str, DataFrame], title: str = "Corpus profile", most: int = 200) -> str:
    """Tables of small frames, escaped; at most `most` rows each are shown."""
    out = [f"<html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(most).collect())
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join([*out, "</body></html>"])


def write_json(row: dict, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        json.dump(row, f, ensure_ascii=False, indent=2)
