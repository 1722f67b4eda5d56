"""Whole plans over many questions at once: retrieve, rerank, gate, rewrite, expand, trim, prompt, generate, parse."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import answers, context, fuse, lexical, rounds, segment, vector
from quarry.plans.adapters import Model, adapter, generated
from quarry.sources.tables import Config, scratch, stored


def health() -> dict[str, bool]:
    return {"ok": True}


def build_corpus(pages: DataFrame, names: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """The chunk table of pages (doc_id, page_num, text) as the configuration's ingest section asks."""
    i = config.ingest
    kept = pages if i.max_pages is None else pages.where(F.col("page_num") <= i.max_pages)
    return segment.corpus(kept, names, least=i.min_chunk_chars, most=i.max_chunk_chars, last_toc_page=i.max_toc_page)


@dataclass
class Engine:
    """chunks: the chunk table; vectors: chunk_id, embedding, or None; a question frame has query_id, question, and embedding
    where vectors are used. Ids of chunks are numbered once, so that retrieval moves numbers, not strings. index: a stored
    lexical index of index_texts(); without one it is built for each search. model: makes the generating model; None takes the
    configuration's. number: a column of chunks with a unique integer for each; None takes the id's 64-bit hash. Hits of one score
    are in the order of these numbers."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    config: Config = Config()
    scorer: Callable[[DataFrame], DataFrame] | None = fuse.lexical_scorer
    model: Callable[[], Model] | None = None
    index: lexical.Index | None = None
    number: str | None = None

    def __post_init__(self) -> None:
        self.docs = self.chunks.select((F.col(self.number).cast("bigint") if self.number else F.xxhash64("chunk_id")).alias("doc_id"), *[F.col(c).alias("document" if c == "doc_id" else c) for c in self.chunks.columns if c not in ("text", "document")], T.search_text(F.col("title"), F.col("clause_id"), F.col("text")).alias("text"))
        if self.model is None:
            self.model = adapter(self.config.model.adapter, self.config.model.name, self.config.model.url)

    def index_texts(self) -> DataFrame:
        """doc_id, text: what a lexical index is built of."""
        return self.docs.select("doc_id", "text")

    def _where(self, filters: dict[str, str] | None) -> Column | None:
        named = {"document" if k == "doc_id" else k: v for k, v in fuse.definition_first(filters).items()}
        return T.matches(named, self.docs.columns) if named else None

    def retrieve(self, questions: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
        """query_id, doc_id, score, rank: both lists fused; the lexical one alone where there are no vectors."""
        r, where = self.config.retrieval, self._where(filters)
        lists = {"bm25": lexical.search(self.docs, questions.select("query_id", F.col("question").alias("text")), r.bm25_topk, where, self.index)}
        if self.vectors is not None and "embedding" in questions.columns:
            own = self.vectors.join((self.docs.where(where) if where is not None else self.docs).select("chunk_id", "doc_id"), "chunk_id").select("doc_id", "embedding")
            lists["dense"] = vector.search(own, questions.select("query_id", "embedding"), r.dense_topk)
        return fuse.rrf(lists, r.rrf_k, {"bm25": r.weight_bm25, "dense": r.weight_dense}, {"bm25": r.cap_bm25, "dense": r.cap_dense}, r.fused_topk)

    def _ranked(self, questions: DataFrame, fused: DataFrame) -> DataFrame:
        return fuse.rerank(fused, questions.select("query_id", "question"), self.docs.select("doc_id", F.col("text").alias("body")), self.config.retrieval.rerank_topk, self.scorer)

    def reranked(self, questions: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
        return self._ranked(questions, self.retrieve(questions, filters))

    def search(self, questions: DataFrame, filters: dict[str, str] | None = None, top_k: int = 10) -> DataFrame:
        """query_id, rank, chunk_id, score, preview and the chunk's columns; at most 50, and no more than are reranked."""
        hits = self.reranked(questions, filters).where(F.col("rank") <= min(50, max(1, top_k)))
        named = hits.join(self.docs.select("doc_id", "chunk_id"), "doc_id").drop("doc_id")
        return named.join(self.chunks, "chunk_id").withColumn("preview", T.preview(F.col("text"), 300)).drop("text")

    def _generated(self, prompts: DataFrame, **more: float) -> DataFrame:
        m = self.config.model
        return generated(prompts, self.model, **({"max_new_tokens": m.max_new_tokens, "temperature": m.temperature, "top_p": m.top_p} | more))

    def rewritten(self, questions: DataFrame) -> DataFrame:
        """query_id, question (the new one if it is used), raw, clean, used, reject_reason: one guarded rewriting each, at
        temperature 0."""
        raw = self._generated(context.rewrite_prompts(questions), max_new_tokens=64, temperature=0.0, top_p=1.0)
        out = questions.join(raw, "query_id", "left").withColumn("r", T.computed(answers.rewrite_outcome(F.col("raw"), F.col("question"))))
        return out.select("query_id", "r.question", "raw", "r.clean", "r.used", "r.reject_reason")

    def rewritten_unguarded(self, questions: DataFrame) -> DataFrame:
        """query_id, question, raw: the first line of the model's answer, whatever it is; the old question where there is none."""
        raw = self._generated(context.rewrite_prompts(questions), max_new_tokens=64, temperature=0.2, top_p=0.9)
        line = F.get(F.split(T.strip(T.text("raw")), T.LINE_END), F.lit(0))
        return questions.join(raw, "query_id", "left").select("query_id", F.when(T.strip(T.text("raw")) == "", F.col("question")).otherwise(line).alias("question"), "raw")

    def gated(self, questions: DataFrame, filters: dict[str, str] | None = None, rewrite: Callable[[DataFrame], DataFrame] | None = None) -> rounds.Rounds:
        """The last round of each question: its hits, its gate and what was asked. Only questions that fail the gate are asked
        again, while rounds are left; rewrite gets query_id, question and round. Where there may be more rounds than one, the lexical
        index is built once and stored."""
        gate = self.config.gate
        rewrite = rewrite if gate.enabled and gate.max_rounds > 1 else None
        engine = self if self.index or not rewrite else replace(self, index=self.stored_index())
        return rounds.gated(questions, lambda now: engine.retrieve(now, filters), engine._ranked, gate.min_score, rewrite, gate.max_rounds)

    def stored_index(self) -> lexical.Index:
        """The lexical index of index_texts(), written to the shared folder."""
        path = scratch(self.chunks.sparkSession)
        lexical.build(self.index_texts()).save(path)
        return lexical.Index.load(self.chunks.sparkSession, path)

    def contexts(self, seeds: DataFrame, top_k: int) -> DataFrame:
        """query_id, place and the columns of the chunks that go into each prompt."""
        first = seeds.where(F.col("rank") <= max(3, top_k)).join(self.docs.select("doc_id", "chunk_id"), "doc_id").select("query_id", "chunk_id")
        near = context.neighbours(first, self.chunks, self.config.packing.neighbor_window)
        return context.trimmed(near.join(self.chunks, "chunk_id"), self.config.packing.max_context_chars)

    def _answered(self, questions: DataFrame, seeds: DataFrame, top_k: int) -> DataFrame:
        """query_id, prompt, raw, answer, citations, mode."""
        prompts = context.prompts(questions.select("query_id", "question"), self.contexts(seeds, top_k))
        return answers.parsed(prompts.join(self._generated(prompts), "query_id")).select("query_id", "prompt", "raw", "answer", "citations", "mode")

    def ask(self, questions: DataFrame, filters: dict[str, str] | None = None, top_k: int = 5, rewrite: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """query_id, answer, citations, mode, raw, fallback. rewrite: query_id, question to query_id, question, for the
        questions that the gate fails; the guarded rewriting by the model if None."""
        last = self.gated(questions, filters, rewrite or self.rewritten)
        return self._answered(questions, last.seeds, top_k).join(last.gates.select("query_id", "fallback"), "query_id").select("query_id", "answer", "citations", "mode", "raw", "fallback")

    def _tops(self, fused: DataFrame, seeds: DataFrame, k: int = 5) -> DataFrame:
        """query_id, fused_top, reranked_top: score and chunk of the first k hits of both lists."""
        ids = self.docs.select("doc_id", "chunk_id")
        one = lambda df, name: df.where(F.col("rank") <= k).join(ids, "doc_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", "chunk_id"))), lambda x: F.struct(x["score"].alias("score"), x["chunk_id"].alias("chunk_id"))).alias(name))
        return one(fused, "fused_top").join(one(seeds, "reranked_top"), "query_id", "full")

    def logged(self, questions: DataFrame, filters: dict[str, str] | None = None, top_k: int = 5, max_prompt: int = 2000, max_raw: int = 2000, rewrite: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """What ask() gives, with unguarded rewriting where rewrite is None, and what happened on the way: round, query, fused_top, reranked_top,
        prompt and raw (cut, with a note of their length). questions may have asked, the wording for the model where it
        differs from the one that is searched for."""
        last = self.gated(questions, filters, rewrite or self.rewritten_unguarded)
        worded = questions.withColumn("question", F.coalesce("asked", "question")) if "asked" in questions.columns else questions
        out = self._answered(worded, last.seeds, top_k).join(last.asked, "query_id").join(self._tops(last.fused, last.seeds), "query_id", "left")
        return out.select("query_id", "answer", "citations", "mode", "round", "query", "fused_top", "reranked_top", T.truncated(F.col("prompt"), max_prompt).alias("prompt"), T.truncated(F.col("raw"), max_raw).alias("raw"))

    def mini(self, examples: DataFrame, top_k: int = 10, keep_raw: bool = False) -> DataFrame:
        """examples (query_id, question, options, gold, and embedding where vectors are used) answered without the gate, each
        as a multiple-choice prompt, with pred_num, acc, citations and the hits; with keep_raw the first 2,000 characters of
        the answer and 3,000 of the prompt."""
        fused = stored(self.retrieve(examples))
        seeds = stored(self._ranked(examples, fused))
        asked = examples.withColumn("question", T.mcq_prompt(F.col("question"), F.col("options"))).select("query_id", "question")
        out = examples.drop("embedding").join(self._answered(asked, seeds, top_k), "query_id").join(self._tops(fused, seeds), "query_id", "left")
        number = answers.option_number(F.col("answer"))
        more = [F.left("raw", F.lit(2000)).alias("raw"), F.left("prompt", F.lit(3000)).alias("prompt")] if keep_raw else []
        return out.select("query_id", "question", "options", "gold", number.alias("pred_num"), F.col("answer").alias("pred_text"), answers.exact_match(number, F.col("gold")).alias("acc"), "citations", "fused_top", "reranked_top", *more)
