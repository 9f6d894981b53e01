"""What a user may put in place of the built-in embedder, linker, vocabulary, item writer, grader, citation source, relay, key
derivation and clock.

A port takes and gives DataFrames, so an implementation may be a table, column expressions, a pandas UDF or a client that
calls a service from ``mapInPandas``.  The classes below are the built-in ones.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import items as Q
from lumenfold.operators import linking as L
from lumenfold.operators import sync as Y
from lumenfold.operators import vectors as E
from lumenfold.session import Scratch


class Embedder(Protocol):
    model_id: str
    dim: int

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame: ...  # (key, i, x), unit length per key


class Vocabulary(Protocol):
    def candidates(self, forms: DataFrame, limit: int) -> DataFrame: ...  # (form, concepts, exact)

    def hierarchy(self, ids: DataFrame) -> DataFrame: ...  # (from_concept, to_concept, relation)


class Linker(Protocol):
    model_id: str

    def decide(self, requests: DataFrame, found: DataFrame) -> DataFrame: ...  # (id, chunk_id, surface_form, start_char, end_char, concept_id, confidence, is_primary)


class ItemWriter(Protocol):
    model_id: str

    def write(self, evidence: DataFrame, version: DataFrame, concept: DataFrame) -> DataFrame: ...  # (concept_id, kind, prompt, points)


class Grader(Protocol):
    model_id: str

    def score(self, answer: Column, points: Column) -> Column: ...  # 0..1


class ScholarGraph(Protocol):
    def references(self, dois: DataFrame) -> DataFrame: ...  # (from_doi, to_doi)

    def cited_by(self, dois: DataFrame) -> DataFrame: ...  # (from_doi, to_doi)


class Relay(Protocol):
    def push(self, batches: DataFrame) -> None: ...

    def pull(self, spark: SparkSession, cursor: int, limit: int) -> DataFrame: ...


class KeyDerivation(Protocol):
    def derive(self, passphrase: str, salt: bytes) -> bytes: ...


class Clock(Protocol):
    def now(self) -> Column: ...


@dataclass
class HashEmbedder:
    dim: int = 128
    model_id: str = "hash-128"

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        return E.hash_embedding(rows, key, F.col(text), self.dim)


@dataclass
class TableVocabulary:
    concept: DataFrame
    edge: DataFrame
    scratch: Scratch

    def candidates(self, forms: DataFrame, limit: int = L.CANDIDATES) -> DataFrame:
        return L.candidates(forms, L.names(self.concept), limit)

    def hierarchy(self, ids: DataFrame) -> DataFrame:
        return L.ancestors(self.edge, ids, self.scratch)


@dataclass
class RuleLinker:
    model_id: str = "rules"

    def decide(self, requests: DataFrame, found: DataFrame) -> DataFrame:
        r = requests.withColumn("form", L.fold(F.col("surface_form"))).join(found, "form", "left")
        sure = F.when(F.col("concepts").isNull() | F.col("exact"), L.EXACT).otherwise(L.PARTIAL)
        return r.select("id", "chunk_id", "surface_form", "start_char", "end_char", F.col("concepts")[0].alias("concept_id"), sure.alias("confidence"), F.lit(False).alias("is_primary"))


def linked(linker: Linker, requests: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(id, concept_id, confidence, is_primary)``: the decisions of any linker as far as they answer what was asked."""
    found = vocabulary.candidates(requests.select(F.col("surface_form").alias("form")), L.CANDIDATES)
    return L.reconcile(requests, linker.decide(requests, found), found)


@dataclass
class SentenceWriter:
    model_id: str = "sentences"

    def write(self, evidence: DataFrame, version: DataFrame, concept: DataFrame) -> DataFrame:
        return Q.drafts(evidence, version, concept)


@dataclass
class KeywordGrader:
    needed: float = 0.4
    model_id: str = "keywords"

    def score(self, answer: Column, points: Column) -> Column:
        return Q.grade(answer, points, self.needed)


@dataclass
class TableScholarGraph:
    citation: DataFrame

    def references(self, dois: DataFrame) -> DataFrame:
        return self.citation.join(dois.select(F.col("doi").alias("from_doi")).distinct(), "from_doi").select("from_doi", "to_doi")

    def cited_by(self, dois: DataFrame) -> DataFrame:
        return self.citation.join(dois.select(F.col("doi").alias("to_doi")).distinct(), "to_doi").select("from_doi", "to_doi")


@dataclass
class FolderRelay:
    """Batches in a folder that all devices reach, one sub-folder per push."""

    folder: str

    def push(self, batches: DataFrame, cursor: int = 1) -> None:
        batches.write.mode("overwrite").parquet(f"{self.folder}/cursor={cursor}")

    def pull(self, spark: SparkSession, cursor: int = 0, limit: int = 100) -> DataFrame:
        rows = spark.read.parquet(self.folder)
        return rows.filter((F.col("cursor") > cursor) & (F.col("cursor") <= cursor + limit))


@dataclass
class Pbkdf2:
    rounds: int = 600_000

    def derive(self, passphrase: str, salt: bytes) -> bytes:
        return Y.derive_key(passphrase, salt, self.rounds)


@dataclass
class FixedClock:
    """A moment given by the caller; plans never ask the machine."""

    at: dt.datetime

    def now(self) -> Column:
        return F.lit(self.at)
