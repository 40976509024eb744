"""The catalog of virtual machines and right-sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Type, vCPUs, GB of memory, GB of disk, DBU an hour, dollars an hour, category.
CATALOG = (
    ("Standard_DS3_v2", 4, 14.0, 28.0, 0.75, 0.293, "general"),
    ("Standard_DS4_v2", 8, 28.0, 56.0, 1.50, 0.585, "general"),
    ("Standard_DS5_v2", 16, 56.0, 112.0, 3.00, 1.170, "general"),
    ("Standard_D8s_v3", 8, 32.0, 64.0, 2.00, 0.384, "general"),
    ("Standard_D16s_v3", 16, 64.0, 128.0, 4.00, 0.768, "general"),
    ("Standard_D32s_v3", 32, 128.0, 256.0, 8.00, 1.536, "general"),
    ("Standard_D64s_v3", 64, 256.0, 512.0, 12.00, 3.072, "general"),
    ("Standard_E8s_v3", 8, 64.0, 64.0, 1.50, 0.504, "memory"),
    ("Standard_E16s_v3", 16, 128.0, 128.0, 3.00, 1.008, "memory"),
    ("Standard_E32s_v3", 32, 256.0, 256.0, 6.00, 2.016, "memory"),
    ("Standard_E64s_v3", 64, 432.0, 432.0, 12.00, 4.032, "memory"),
    ("Standard_F8s_v2", 8, 16.0, 32.0, 1.50, 0.338, "compute"),
    ("Standard_F16s_v2", 16, 32.0, 64.0, 3.00, 0.677, "compute"),
    ("Standard_F32s_v2", 32, 64.0, 128.0, 6.00, 1.354, "compute"),
    ("Standard_F64s_v2", 64, 128.0, 256.0, 12.00, 2.708, "compute"),
    ("Standard_L8s_v3", 8, 64.0, 160.0, 1.50, 0.624, "storage"),
    ("Standard_L16s_v3", 16, 128.0, 320.0, 3.00, 1.248, "storage"),
    ("Standard_L32s_v3", 32, 256.0, 640.0, 6.00, 2.496, "storage"),
    ("Standard_L64s_v3", 64, 512.0, 1280.0, 12.00, 4.992, "storage"),
    ("Standard_D2ds_v4", 2, 8.0, 75.0, 0.55, 0.138, "general"),
    ("Standard_D4ds_v4", 4, 16.0, 150.0, 1.10, 0.276, "general"),
    ("Standard_E4a_v4", 4, 32.0, 68.0, 0.85, 0.23, "memory"),
    ("Standard_F4s", 4, 8.0, 32.0, 0.90, 0.19, "compute"),
)


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOG), "instance_type string, vcpus int, memory_gb double, storage_gb double, dbu_rate double, usd_per_hour double, category string")


def filtered(instances: DataFrame, category: str | None = None, min_memory: float | None = None, min_vcpus: int | None = None) -> DataFrame:
    if category is not None:
        instances = instances.where(F.col("category") == category)
    if min_memory is not None:
        instances = instances.where(F.col("memory_gb") >= min_memory)
    if min_vcpus is not None:
        instances = instances.where(F.col("vcpus") >= min_vcpus)
    return instances.orderBy("vcpus", "memory_gb", "instance_type")


def neighbours(instances: DataFrame) -> DataFrame:
    """instance_type, smaller, larger: the next of its category by vCPUs; of several, the one with least memory."""
    a, b = instances.alias("a"), instances.select("category", F.col("vcpus").alias("v"), F.struct("memory_gb", "instance_type").alias("m")).alias("b")
    joined = a.join(b, "category", "left").groupBy("instance_type", "vcpus")
    pick = lambda near, order: F.min_by(F.col("m")["instance_type"], F.when(near, F.struct(order.alias("o"), F.col("m").alias("m"))))
    return joined.agg(pick(F.col("v") < F.col("vcpus"), -F.col("v")).alias("smaller"), pick(F.col("v") > F.col("vcpus"), F.col("v")).alias("larger")).select("instance_type", "smaller", "larger")


def recommended(profiles: DataFrame, instances: DataFrame) -> DataFrame:
    """id, category, instance_type of profiles (id, spill_bytes, compute_intensity, memory_intensity): the smallest of
    the category that the profile asks for."""
    need = lambda category, gb: F.struct(F.lit(category).alias("category"), F.lit(gb).alias("gb"))
    want = F.when(F.col("spill_bytes") > 0, need("memory", 64.0)).when(F.col("compute_intensity") > 0.7, need("compute", 16.0)).when(F.col("memory_intensity") > 0.7, need("memory", 32.0)).otherwise(need("general", 14.0))
    asked = profiles.select("id", want.alias("w")).select("id", "w.*")
    fits = asked.join(instances, "category").where("memory_gb >= gb")
    return fits.groupBy("id", "category").agg(F.min_by("instance_type", F.struct("vcpus", "memory_gb", "instance_type")).alias("instance_type"))


def right_sized(workers: Column, cpu_pct: Column, memory_pct: Column) -> Column:
    """Workers after one step: fewer where both are idle, two more where either is busy; 2 to 8, and 2 if unknown."""
    n = F.coalesce(workers, F.lit(2))
    return F.when((memory_pct < 30) & (cpu_pct < 40), F.greatest(n - 1, F.lit(2))).when((memory_pct > 70) | (cpu_pct > 70), F.least(n + 2, F.lit(8))).otherwise(n)


def within_addresses(workers: Column, addresses: Column) -> Column:
    """Workers that a subnet of so many addresses holds beside the driver."""
    return F.when(addresses.isNotNull(), F.greatest(F.least(workers, addresses - 1), F.lit(1))).otherwise(workers)
