"""Boilerplate rules over parsed methods (class_key, name, n_statements, first_kind) and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
NAMES = ("toString", "hashCode", "equals", "canEqual", "builder", "toBuilder")
LOMBOK = ("Data", "Value", "Getter", "Setter", "Builder", "NoArgsConstructor", "AllArgsConstructor", "RequiredArgsConstructor", "EqualsAndHashCode", "ToString")


def is_boilerplate_method(name: Column, n_statements: Column, first_kind: Column) -> Column:
    """A known name; get/is/has with one return; set with one assignment. A bare prefix is no accessor; get wins over is and has."""
    prefix = lambda p: F.startswith(name, F.lit(p)) & (F.length(name) > len(p))
    one = lambda kind: F.coalesce((n_statements == 1) & (first_kind == kind), F.lit(False))
    return name.isin(*NAMES) | F.when(prefix("get"), one("return")).when(prefix("set"), one("assign")).when(prefix("is") | prefix("has"), one("return")).otherwise(False)


def dto_classes(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(class_key, is_dto). classes: class_key, annotation_names, n_fields. Constructors are no methods."""
    own = methods.groupBy("class_key").agg(F.bool_and(is_boilerplate_method(F.col("name"), F.col("n_statements"), F.col("first_kind"))).alias("all_plain"))
    lombok = F.arrays_overlap("annotation_names", F.array(*map(F.lit, LOMBOK)))
    return classes.join(own, "class_key", "left").select("class_key", F.when(F.col("all_plain").isNotNull(), F.col("all_plain")).otherwise(lombok | (F.col("n_fields") > 0)).alias("is_dto"))


def mark(methods: DataFrame, dtos: DataFrame) -> DataFrame:
    """is_boilerplate: a method of a DTO or by W1-W3; a constructor only in a DTO."""
    plain = is_boilerplate_method(F.col("name"), F.col("n_statements"), F.col("first_kind"))
    return methods.join(dtos, "class_key", "left").withColumn("is_boilerplate", F.coalesce("is_dto", F.lit(False)) | ((F.col("name") != "<init>") & plain)).drop("is_dto")


def drop(chunks: DataFrame) -> DataFrame:
    """After reverse edges are in."""
    return chunks.where(~F.col("is_boilerplate"))
