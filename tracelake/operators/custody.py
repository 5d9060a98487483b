"""Evidence custody: hashes, Merkle trees and proofs, certificates, an append-only ledger."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import re
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.sources.ranges import file_digests
from tracelake.tables import Tables

#: Leaves of a range that are numbered together.
RANGE_ROWS = 1_000_000


def safe_path(target: str, base: str | None = None) -> str:
    """The real path of a regular local file; raises ValueError where it leaves the base or isn't a file."""
    real = os.path.realpath(target)
    if base is not None and os.path.commonpath([os.path.realpath(base), real]) != os.path.realpath(base):
        raise ValueError(f"{target} is outside {base}")
    if not os.path.exists(real):
        raise FileNotFoundError(real)
    if not os.path.isfile(real):
        raise ValueError(f"{real} is not a regular file")
    return real


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files of any size, read by pages."""
    return file_digests(spark, path).withColumnRenamed("size", "length")


def same_digest(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def pair_hash(left: Column, right: Column) -> Column:
    """SHA-256 of the byte 1 and both digests."""
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def leaf_hash(data: Column) -> Column:
    """SHA-256 of the byte 0 and the data."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), data.cast("binary")), 256)


def number_leaves(leaves: DataFrame, order: str) -> DataFrame:
    """idx from 0 by order, ties by hash (equal rows are alike), without one task for all.

    Sorted rows lie in ranges as many as they need; ranges are counted, then numbered inside.
    """
    ties = [c for c in ("hash",) if c in leaves.columns]
    tables = Tables(leaves.sparkSession)
    parts = max(1, -(-leaves.count() // RANGE_ROWS))
    sorted_ = leaves.repartitionByRange(parts, order, *ties).sortWithinPartitions(order, *ties)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = tables.put("leaves", sorted_.withColumns({"_part": F.spark_partition_id(), "_i": place}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row a range
    return placed.join(F.broadcast(base), "_part").select(*leaves.columns, (F.col("_base") + F.col("_i")).cast("long").alias("idx"))


def merkle_levels(leaves: DataFrame) -> DataFrame:
    """(level, idx, hash) of the whole tree over leaves (idx, hash); a lone last node moves up as it is."""
    now = leaves.select(F.lit(0).alias("level"), F.col("idx").cast("long").alias("idx"), "hash").checkpoint()
    levels, n = now, now.count()
    level = 0
    while n > 1:
        half = now.groupBy(F.expr("idx div 2").alias("idx")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("hash"))).alias("a"), F.max(F.when(F.col("idx") % 2 == 1, F.col("hash"))).alias("b"))
        level, n = level + 1, (n + 1) // 2
        now = half.select(F.lit(level).alias("level"), "idx", F.when(F.col("b").isNull(), F.col("a")).otherwise(pair_hash(F.col("a"), F.col("b"))).alias("hash")).checkpoint()
        levels = levels.union(now)
    return levels


def merkle_root(levels: DataFrame) -> DataFrame:
    """The root; of no leaves the hash of nothing."""
    return levels.agg(F.coalesce(F.max_by("hash", "level"), F.lit(hashlib.sha256(b"").hexdigest())).alias("root"), F.count_if(F.col("level") == 0).alias("n_leaves"))


def merkle_proofs(levels: DataFrame, leaves: DataFrame) -> DataFrame:
    """(idx, leaf, proof): the siblings of each wanted leaf (idx), from below, with their side."""
    top = levels.agg(F.max("level")).first()[0] or 0
    want = leaves.select("idx", F.explode(F.sequence(F.lit(0), F.lit(max(0, top - 1)))).alias("level")).withColumn("sibling", F.expr("shiftright(idx, level) ^ 1L"))
    at = levels.select("level", F.col("idx").alias("sibling"), "hash")
    steps = want.join(at, ["level", "sibling"]).groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("level", "hash", F.when(F.col("sibling") % 2 == 0, "left").otherwise("right").alias("side")))).alias("proof"))
    own = levels.where("level = 0").select("idx", F.col("hash").alias("leaf"))
    return leaves.select("idx").join(own, "idx").join(steps, "idx", "left").select("idx", "leaf", F.coalesce("proof", F.array().cast("array<struct<level:int,hash:string,side:string>>")).alias("proof"))


def proof_root(leaf: Column, proof: Column) -> Column:
    """The root that a proof leads to."""
    return F.aggregate(proof, leaf, lambda h, p: F.when(p["side"] == "left", pair_hash(p["hash"], h)).otherwise(pair_hash(h, p["hash"])))


def audit(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Stored against recomputed hashes: INTACT, TAMPERED or MISSING."""
    joined = evidence.join(files.select(F.col("path").alias("source_path"), "sha256"), "source_path", "left")
    status = F.when(F.col("sha256").isNull(), "MISSING").when(same_digest(F.col("hash_value"), F.col("sha256")), "INTACT").otherwise("TAMPERED")
    return joined.withColumn("status", status)


def canonical_json(value: dict) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()


def certificate(case_id: str, root: str, evidence: list[tuple[str, str]], secret: bytes, signer: str, when: str | None = None) -> dict:
    """A signed certificate (HMAC-SHA256 over canonical JSON) for listed (id, hash) pairs."""
    body = {
        "certificate_id": str(uuid.uuid4()), "case_id": case_id, "root_hash": root, "algorithm": "sha256", "total_evidences": len(evidence), "evidence_ids": [i for i, _ in evidence], "evidence_hashes": [h for _, h in evidence],
        "generated_at": when or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "signer_identity": signer, "signature_algorithm": "HMAC-SHA256",
    }
    return {**body, "signature": hmac.new(secret, canonical_json(body), hashlib.sha256).hexdigest()}


def verify_certificate(cert: dict, secret: bytes) -> bool:
    body = {k: v for k, v in cert.items() if k != "signature"}
    return hmac.compare_digest(hmac.new(secret, canonical_json(body), hashlib.sha256).hexdigest(), str(cert.get("signature", "")))


class Ledger:
    """An append-only table of evidence, roots or certificates: rows are added, never changed; a known id is refused.

    Rows are written to a folder of their own first, and count once a commit names it. Commits are numbered files,
    which appear whole and only if no writer has made that number; who comes second looks at the new rows and
    tries the next one. So of two writers of an id one fails, and what a killed writer leaves is never read.
    Reads of a ledger without rows give None, or 0 for counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.path).getFileSystem(self._conf)

    def commits(self) -> list[tuple[int, str]]:
        """(number, folder of rows) of every commit, in order."""
        folder = self._path(f"{self.path}/commits")
        if not self._files.exists(folder):
            return []
        numbers = sorted(int(n) for x in self._files.listStatus(folder) if re.fullmatch("[0-9]{12}", n := x.getPath().getName()))
        found = self.spark.sparkContext.wholeTextFiles(",".join(f"{self.path}/commits/{n:012d}" for n in numbers)) if numbers else None
        return sorted((int(p.rsplit("/", 1)[1]), t.strip()) for p, t in found.collect()) if found else []  # a row a commit

    def _commit(self, number: int, rows: str) -> bool:
        """Makes the commit of that number, unless a writer has: a whole file takes its name in one step."""
        own, target = self._path(f"{self.path}/rows/{rows}.commit"), self._path(f"{self.path}/commits/{number:012d}")
        self._files.mkdirs(target.getParent())
        out = self._files.create(own, True)
        out.write(rows.encode())
        out.close()
        try:
            if self._files.getScheme() == "file":  # a local rename would take the place of a file
                os.link(own.toUri().getPath(), target.toUri().getPath())
            else:
                jvm = self.spark.sparkContext._jvm
                kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
                options = self.spark.sparkContext._gateway.new_array(kind, 1)
                options[0] = kind.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf).rename(own, target, options)
        except FileExistsError:
            return False
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            self._files.delete(own, False)
        return True

    def read(self) -> DataFrame | None:
        return self._rows(self.commits())

    def _rows(self, commits: list[tuple[int, str]]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/rows/{f}" for _, f in commits)) if commits else None

    def find(self, **values) -> DataFrame | None:
        """The rows that equal the values; hashes are compared in lower case."""
        found = self.read()
        for c, v in values.items() if found is not None else ():
            found = found.where(F.lower(c) == v.lower() if c.endswith("hash") or c == "hash_value" else F.col(c) == v)
        return found

    def listing(self, case_id: str | None = None, order: str = "created_at", key: str = "evidence_id") -> DataFrame | None:
        """The rows of all cases, or of one, by time and key."""
        found = self.find() if case_id is None else self.find(case_id=case_id)
        return None if found is None else found.orderBy(order, key)

    def count(self, case_id: str | None = None) -> int:
        found = self.find() if case_id is None else self.find(case_id=case_id)
        return 0 if found is None else found.count()

    def latest(self, case_id: str | None = None, order: str = "created_at", key: str = "root_hash") -> DataFrame | None:
        """The last row by time, ties by key: the latest root of all, or of a case."""
        found = self.find() if case_id is None else self.find(case_id=case_id)
        return None if found is None else found.orderBy(F.desc(order), F.desc(key)).limit(1)

    def append(self, rows: DataFrame, key: str = "evidence_id", hashed: str = "hash_value") -> int:
        """Adds the rows whose hash is 64 hex digits; raises if an id is there already."""
        name = uuid.uuid4().hex
        rows.where(F.col(hashed).rlike("^[0-9a-fA-F]{64}$")).write.parquet(f"{self.path}/rows/{name}")
        own = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/{name}")
        clash = not own.groupBy(key).count().where("count > 1").isEmpty()
        while not clash:
            commits = self.commits()
            known = self._rows(commits)
            clash = known is not None and not own.join(known, key, "left_semi").isEmpty()
            if not clash and self._commit(commits[-1][0] + 1 if commits else 1, name):
                return own.count()
        self._files.delete(self._path(f"{self.path}/rows/{name}"), True)
        raise ValueError("evidence is append-only: an id is there already")


def audit_verdict(audited: DataFrame, root: str | None = None, expected: str | None = None) -> DataFrame:
    """One row: how many items are intact, tampered and missing; whether the root is the expected one; and the verdict.

    VALID needs all intact and, where a root is expected, that one; no items are VALID.
    """
    n = lambda s: F.count_if(F.col("status") == s)
    same = None if expected is None else (root or "").strip().lower() == expected.strip().lower()
    got = audited.agg(F.count("*").alias("n_items"), n("INTACT").alias("n_intact"), n("TAMPERED").alias("n_tampered"), n("MISSING").alias("n_missing"))
    whole = (F.col("n_intact") == F.col("n_items")) & F.lit(same is not False)
    return got.withColumns({"root_matches": F.lit(same).cast("boolean"), "verdict": F.when(whole, "VALID").otherwise("COMPROMISED")})
