"""Changes of grants under the rule that a base keeps an administrator (M4)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGED, UNCHANGED, INVALID, MISSING, LAST_ADMIN = "CHANGED", "UNCHANGED", "PERMISSION_SUBJECT_INVALID", "NOT_FOUND", "LAST_ADMIN_REQUIRED"
_KEYS = ["tenant_id", "kb_id", "subject"]
_OUT = "tenant_id int, kb_id int, seq long, subject string, permission string, code string, previous string, acl_version long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes sorted by base and seq, with what was there before, to their outcomes. Of a base only its number of available
    administrators, its version and the grants that changes touch are kept."""
    base, admins, version, held = None, 0, 0, {}
    for b in batches:
        codes, before, versions = [], [], []
        for tenant, kb, subject, permission, old, valid, available, first_admins, first_version in zip(*(b.column(c).to_pylist() for c in ("tenant_id", "kb_id", "subject", "permission", "old", "valid", "available", "admins", "version"))):
            if (tenant, kb) != base:
                base, admins, version, held = (tenant, kb), first_admins, first_version, {}
            previous = held.get(subject, old)
            after = admins + ((permission == "ADMIN") - (previous == "ADMIN") if available else 0)
            if permission is None and previous is None:
                code = MISSING
            elif permission is not None and not valid:
                code = INVALID
            elif after < 1:
                code = LAST_ADMIN
            else:
                code = UNCHANGED if permission == previous else CHANGED
                version += code == CHANGED
                admins, held[subject] = after, permission
            codes.append(code)
            before.append(previous)
            versions.append(version)
        columns = [b.column(c) for c in ("tenant_id", "kb_id", "seq", "subject", "permission")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.string()), pa.array(before, pa.string()), pa.array(versions, pa.int64())], [x.split()[0] for x in _OUT.split(", ")])


def outcomes(bases: DataFrame, grants: DataFrame, changes: DataFrame, subjects: DataFrame) -> DataFrame:
    """changes with code, previous (the permission before) and acl_version (of the base, after the change).

    bases: (tenant_id, kb_id, acl_version); grants: (tenant_id, kb_id, subject, permission), one for each subject; changes: the
    same with seq, where no permission revokes; subjects: (tenant_id, subject, valid, available), available if it stands for
    an active member. Changes of a base apply in the order of seq. One that no available administrator would be left after
    is refused as LAST_ADMIN_REQUIRED and changes nothing, as are grants to invalid subjects and the revocation of what is not
    there. A change that makes a difference brings the old version plus one.
    """
    who = subjects.select("tenant_id", "subject", "valid", "available")
    have = grants.join(who.where("available"), ["tenant_id", "subject"]).where("permission = 'ADMIN'").groupBy("tenant_id", "kb_id").agg(F.count(F.lit(1)).alias("admins"))
    rows = changes.join(bases.select("tenant_id", "kb_id", F.col("acl_version").alias("version")), ["tenant_id", "kb_id"])
    rows = rows.join(grants.select(*_KEYS, F.col("permission").alias("old")), _KEYS, "left").join(who, ["tenant_id", "subject"], "left").join(have, ["tenant_id", "kb_id"], "left")
    rows = rows.select(F.col("tenant_id").cast("int"), F.col("kb_id").cast("int"), F.col("seq").cast("long"), "subject", "permission", "old", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("valid", "available")], F.coalesce("admins", F.lit(0)).alias("admins"), F.col("version").cast("long").alias("version"))
    return rows.repartition("tenant_id", "kb_id").sortWithinPartitions("tenant_id", "kb_id", "seq").mapInArrow(_fold, _OUT)


def merged(grants: DataFrame, told: DataFrame) -> DataFrame:
    """grants after the changes that outcomes() let pass."""
    last = told.where(F.col("code") == CHANGED).groupBy(*_KEYS).agg(F.max_by(F.struct("permission"), "seq").alias("now"))
    both = grants.join(last, _KEYS, "full_outer").select(*_KEYS, F.when(F.col("now").isNotNull(), F.col("now.permission")).otherwise(F.col("permission")).alias("permission"))
    return both.where("permission is not null")
