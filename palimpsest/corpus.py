"""A corpus: a frame of documents with their derived slots, and what was left out of it."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, tokenizers
from .runtime import written
from .sources import text as sources

SLOTS = ("doc_id", "content", "tokens", "hashes", "minhashes", "meta")
EMPTY = {"content": "string", "tokens": "array<string>", "hashes": "array<bigint>", "minhashes": "array<bigint>", "meta": "map<string,string>"}

Slot = Callable[[Column], Column]


def _name(f) -> str:
    return getattr(f, "__name__", type(f).__name__)


def _tokens(tokenizer: Slot, args: Mapping) -> Column:
    """The tokenizer on the content, with the arguments it knows; n and k may serve the rule on short documents alone."""
    known = inspect.signature(tokenizer).parameters
    every = any(p.kind is p.VAR_KEYWORD for p in known.values())
    unknown = [x for x in args if not every and x not in known and x not in ("n", "k")]
    if unknown:
        raise TypeError(f"{_name(tokenizer)} has no argument {', '.join(unknown)}")
    return tokenizer(F.col("content"), **{x: v for x, v in args.items() if every or x in known})


def _least(tokenizer: Slot | None, args: Mapping) -> int:
    """Words that the tokenizer with these arguments needs: those of 3-grams if it says nothing of its own."""
    skips = tokenizer is tokenizers.skip_ngrams
    return tokenizers.minimum_words(args.get("n", 3), args.get("k", 1 if skips else 0))


@dataclass(frozen=True)
class Document:
    """One document of a corpus in the driver; a slot that is absent is None."""

    doc_id: object
    content: str | None = None
    tokens: list[str] | None = None
    hashes: list[int] | None = None
    minhashes: list[int] | None = None
    meta: dict[str, str] = field(default_factory=dict)

    def has(self, name: str) -> bool:
        if name not in EMPTY:
            raise ValueError(f"{name} is no slot")
        return getattr(self, name) is not None

    def with_slots(self, **values) -> "Document":
        """A copy with other slots; of ``meta`` the tags given are set."""
        if "meta" in values:
            values["meta"] = dict(sorted({**self.meta, **values["meta"]}.items()))
        return replace(self, **values)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        kind = "bigint" if isinstance(self.doc_id, int) else "string"
        row = tuple(getattr(self, x) for x in SLOTS)
        return spark.createDataFrame([row], f"doc_id {kind}, " + ", ".join(f"{x} {t}" for x, t in EMPTY.items()))

    def __str__(self) -> str:
        return self.content or ""

    def __repr__(self) -> str:
        head = "\n".join(f"{k}: {v}" for k, v in self.meta.items())
        return f"Document {self.doc_id}\n{head}\ncontent: {str(self)[:200]}"


@dataclass(frozen=True)
class Corpus:
    """Documents as rows ``(doc_id, content, tokens, hashes, minhashes, meta)``; absent slots are null.

    Lazy but for the check of the ids. ``skipped`` has the ids that were too short.
    """

    docs: DataFrame
    skipped: DataFrame
    meta: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def of(
        cls,
        source: DataFrame,
        tokenizer: Slot | None = tokenizers.ngrams,
        hash_func: Slot = hashing.hash_tokens,
        minhash_func: Slot | None = None,
        keep_tokens: bool = False,
        keep_text: bool = True,
        skip_short: bool = True,
        meta: Mapping[str, str] | None = None,
        unique: bool = True,
        **args,
    ) -> "Corpus":
        """From rows ``(doc_id, content, meta)``. ``args`` (n, k, lowercase, ...) go to the tokenizer.

        Documents of fewer words than the tokenizer needs by its n and k, and null ones, are skipped. Ids that repeat are
        an error, found at once by one aggregation of the ids; ``unique=False`` leaves that out where they are known
        to be unique.
        """
        if unique and not source.groupBy("doc_id").count().where("count > 1").isEmpty():
            raise ValueError("ids must be unique")
        long_enough = F.coalesce(tokenizers.word_count(F.col("content")) >= _least(tokenizer, args), F.lit(False))
        kept = source.where(long_enough) if skip_short else source
        skipped = source.where(~long_enough).select("doc_id") if skip_short else source.select("doc_id").limit(0)
        note = {"tokenizer": _name(tokenizer) if tokenizer else "", "hash_func": _name(hash_func), "minhash_func": _name(minhash_func) if minhash_func else ""}
        docs = kept.withColumn("meta", _tagged(F.col("meta"), {k: F.lit(v) for k, v in note.items() if v}))
        return cls(_slots(docs, tokenizer, hash_func, minhash_func, keep_tokens, keep_text, args), skipped, dict(sorted((meta or {}).items())))

    @classmethod
    def from_texts(cls, spark: SparkSession, texts: Sequence[str] | Mapping[str, str], **options) -> "Corpus":
        return cls.of(sources.from_texts(spark, texts), **options)

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8", **options) -> "Corpus":
        return cls.of(sources.from_paths(spark, paths, encoding), **options)

    @classmethod
    def from_dir(cls, spark: SparkSession, folder: str, encoding: str = "UTF-8", **options) -> "Corpus":
        return cls.of(sources.from_dir(spark, folder, encoding), **options)

    @classmethod
    def from_dataframe(cls, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> "Corpus":
        return cls.of(sources.from_dataframe(df, id_col, text_col), **options)

    def tokenize(self, tokenizer: Slot, hash_func: Slot = hashing.hash_tokens, minhash_func: Slot | None = None, keep_tokens: bool = True, keep_text: bool = True, **args) -> "Corpus":
        """Tokens and hashes anew from the content; signatures are dropped unless ``minhash_func`` makes new ones."""
        return replace(self, docs=_slots(self.docs.drop("tokens", "hashes", "minhashes"), tokenizer, hash_func, minhash_func, keep_tokens, keep_text, args))

    def rehash(self, func: Slot, kind: str = "hashes") -> "Corpus":
        """Hashes or signatures anew from the kept tokens; a document without tokens is an error."""
        if kind not in ("hashes", "minhashes"):
            raise ValueError("kind must be hashes or minhashes")
        have = F.when(F.col("tokens").isNotNull(), func(F.col("tokens"))).otherwise(F.raise_error(F.lit("documents must keep their tokens to be hashed again")))
        return replace(self, docs=self.docs.withColumn(kind, have))

    def slot(self, name: str) -> DataFrame:
        """``(doc_id, slot)``."""
        return self.docs.select("doc_id", name)

    def with_slot(self, name: str, value: Column | DataFrame) -> "Corpus":
        """Another slot: an expression over the documents, or rows ``(doc_id, value)``; documents without a row get null."""
        if name not in EMPTY:
            raise ValueError(f"{name} is no slot")
        if isinstance(value, Column):
            return replace(self, docs=self.docs.withColumn(name, value.cast(EMPTY[name])).select(*SLOTS))
        new = value.toDF("doc_id", name).withColumn(name, F.col(name).cast(EMPTY[name]))
        return replace(self, docs=self.docs.drop(name).join(new, "doc_id", "left").select(*SLOTS))

    def has(self, name: str) -> bool:
        """Whether every document has the slot."""
        return bool(self.docs.agg(F.coalesce(F.bool_and(F.col(name).isNotNull()), F.lit(False))).first()[0])

    def has_each(self, name: str) -> DataFrame:
        """``(doc_id, has)`` of every document."""
        return self.docs.select("doc_id", F.col(name).isNotNull().alias("has"))

    def subset(self, ids: Sequence | DataFrame) -> "Corpus":
        """Some documents; meta and skipped ids stay."""
        if isinstance(ids, DataFrame):
            return replace(self, docs=self.docs.join(ids.toDF("doc_id").distinct(), "doc_id", "left_semi"))
        return replace(self, docs=self.docs.where(F.col("doc_id").isin(list(ids))))

    def positions(self) -> DataFrame:
        """``(doc_id, position)``, from 0 in the order of the ids, without a window over all rows."""
        spark = self.docs.sparkSession
        placed = written(self.docs.select("doc_id").orderBy("doc_id").withColumn("at", F.monotonically_increasing_id()), "positions")
        # one row for each partition of the sort
        sizes = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
        before, total = [], 0
        for r in sizes:
            before.append((r.part, total))
            total += r.n
        offsets = spark.createDataFrame(before, "part long, before long")
        at = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part")
        return at.select("doc_id", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("position"))

    def take(self, positions: Sequence[int]) -> "Corpus":
        """The documents at these positions in the order of the ids."""
        return self.subset(self.positions().where(F.col("position").isin(list(positions))).select("doc_id"))

    def document(self, doc_id) -> Document | None:
        row = self.docs.where(F.col("doc_id") == doc_id).first()
        return None if row is None else Document(**{x: row[x] if x != "meta" else row[x] or {} for x in SLOTS})

    def names(self) -> DataFrame:
        return self.docs.select("doc_id")

    def rename(self, mapping: DataFrame) -> "Corpus":
        """New ids from rows ``(old, new)``; ids that aren't in it stay, and so does ``meta``."""
        m = mapping.toDF("doc_id", "__new")
        return replace(self, docs=self.docs.join(m, "doc_id", "left").withColumn("doc_id", F.coalesce("__new", "doc_id")).drop("__new"))

    def with_meta(self, **tags: str) -> "Corpus":
        return replace(self, meta=dict(sorted({**self.meta, **tags}.items())))

    def doc_meta(self, tag: str) -> DataFrame:
        return self.docs.select("doc_id", F.element_at("meta", tag).alias(tag))

    def with_doc_meta(self, tag: str, value: Column | DataFrame) -> "Corpus":
        """A tag of every document: an expression over the documents, or rows ``(doc_id, value)``; null takes it away."""
        if isinstance(value, Column):
            docs = self.docs.withColumn("__v", value.cast("string"))
        else:
            docs = self.docs.join(value.toDF("doc_id", "__v").withColumn("__v", F.col("__v").cast("string")), "doc_id", "left")
        return replace(self, docs=docs.withColumn("meta", _tagged(F.col("meta"), {tag: F.col("__v")})).select(*SLOTS))

    def __len__(self) -> int:
        return self.docs.count()

    def __repr__(self) -> str:
        return f"Corpus({', '.join(f'{k}: {v}' for k, v in self.meta.items()) or 'no meta'}; slots {', '.join(self.docs.columns)})"


def _tagged(meta: Column, tags: Mapping[str, Column]) -> Column:
    """The map with the tags set, in the order of its keys; a null value takes a tag away."""
    kept = F.map_filter(F.coalesce(meta, F.create_map().cast(EMPTY["meta"])), lambda k, _: ~k.isin(list(tags)))
    new = F.map_filter(F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, new))))


def _slots(docs: DataFrame, tokenizer, hash_func, minhash_func, keep_tokens: bool, keep_text: bool, args: Mapping) -> DataFrame:
    out = docs
    out = out.withColumn("tokens", _tokens(tokenizer, args) if tokenizer else F.lit(None).cast(EMPTY["tokens"]))
    out = out.withColumn("hashes", hash_func(F.col("tokens")) if tokenizer else F.lit(None).cast(EMPTY["hashes"]))
    out = out.withColumn("minhashes", minhash_func(F.col("tokens")) if tokenizer and minhash_func else F.lit(None).cast(EMPTY["minhashes"]))
    if not keep_tokens:
        out = out.withColumn("tokens", F.lit(None).cast(EMPTY["tokens"]))
    if not keep_text:
        out = out.withColumn("content", F.lit(None).cast(EMPTY["content"]))
    return out.select(*SLOTS)


def is_corpus(x) -> bool:
    return isinstance(x, Corpus)


def is_document(x) -> bool:
    return isinstance(x, Document)


def is_documents(df: DataFrame) -> bool:
    return set(SLOTS) <= set(df.columns)


def is_lsh_buckets(df: DataFrame) -> bool:
    return df.columns == ["doc", "buckets"]


def is_candidates(df: DataFrame) -> bool:
    return {"a", "b", "score"} <= set(df.columns)
