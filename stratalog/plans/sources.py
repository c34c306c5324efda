"""Package tables, archives and codecs over packages and archives generated from the tables, compared with SQL over those."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..registry import query
from ..sources.archives import archive_members, write_mod, write_pak
from ..sources.codecs import zlib_round_trip
from ..sources.packages import package_tables, write_package
from ..tables import table

#: Versions of the generated packages; below zero those of engine 4.
VERSIONS = (61, 68, 128, 400, 864, -352, -517)


def _packages(spark, sf):
    """Forty parts a package: each an import below the one before, and an export of that class."""
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 40).alias("file_id"), "p_partkey", "p_name", "p_type", "p_brand", "p_size")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, f = pdf.sort_values("p_partkey"), int(pdf["file_id"].iloc[0])
        names = sorted({*pdf["p_name"], *pdf["p_type"], *pdf["p_brand"]})
        imports = [{"class_package": b, "class_name": t, "outer_index": -i, "object_name": n} for i, (n, t, b) in enumerate(zip(pdf["p_name"], pdf["p_type"], pdf["p_brand"], strict=True))]
        exports = [{"class": -i - 1, "outer_index": 0, "object_name": n, "flags": int(s), "serial_size": int(s)} for i, (n, s) in enumerate(zip(pdf["p_name"], pdf["p_size"], strict=True))]
        version = VERSIONS[f % len(VERSIONS)]
        return pd.DataFrame({"path": [str(f)], "content": [write_package(version, names, imports, exports, packed=version == 864)]})

    return p.groupBy("file_id").applyInPandas(build, "path string, content binary")


_F = "f AS (SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS file_id, p_partkey, p_name, p_type, p_brand, p_size, row_number() OVER (PARTITION BY floor(p_partkey / 40) ORDER BY p_partkey) - 1 AS i FROM part)"


@query(f"WITH {_F} SELECT file_id, 'imports' AS section, i AS index, p_name AS object_name, p_type AS class_name, p_brand AS class_package, -i AS outer_index, NULL AS flags FROM f UNION ALL SELECT file_id, 'exports', i, p_name, p_name, lag(p_name) OVER (PARTITION BY file_id ORDER BY i), 0, p_size FROM f")
def package_imports_exports(spark, sf):
    t = package_tables(_packages(spark, sf)).where("section <> 'names'")
    return t.select(F.col("path").cast("long").alias("file_id"), "section", "index", "object_name", "class_name", "class_package", "outer_index", "flags")


@query(f"WITH {_F} SELECT file_id, count(DISTINCT n) AS names FROM (SELECT file_id, unnest([p_name, p_type, p_brand]) AS n FROM f) GROUP BY file_id")
def package_name_counts(spark, sf):
    t = package_tables(_packages(spark, sf)).where("section = 'names'")
    return t.groupBy(F.col("path").cast("long").alias("file_id")).agg(F.count("*").alias("names"))


def _archives(spark, sf):
    """Twenty pages an archive, of three kinds."""
    p = table(spark, sf, "pages").select(F.floor(F.col("page_id") / 20).alias("a"), "page_id", F.coalesce("html", F.lit("")).alias("html"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        a = int(pdf["a"].iloc[0])
        members = {f"pages/{i}.html": h.encode() for i, h in zip(pdf["page_id"], pdf["html"], strict=True)}
        if a % 3 == 0:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for k, v in members.items():
                    z.writestr(k, v)
            data = out.getvalue()
        else:
            data = write_mod(members) if a % 3 == 1 else write_pak(members, 3 + a % 7, packed=a % 2 == 0)
        return pd.DataFrame({"path": [f"a{a}"], "content": [data]})

    return p.groupBy("a").applyInPandas(build, "path string, content binary")


@query("SELECT 'a' || CAST(CAST(floor(page_id / 20) AS BIGINT) AS VARCHAR) || '!pages/' || CAST(page_id AS VARCHAR) || '.html' AS path, strlen(coalesce(html, '')) AS size, md5(coalesce(html, '')) AS md5, 'ok' AS status FROM pages")
def archive_members_read(spark, sf):
    return archive_members(_archives(spark, sf)).select("path", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("md5"), "status")


@query("SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes_in, true AS equal FROM documents")
def zlib_codecs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", zlib_round_trip(F.col("text")).alias("r")).select("doc_id", "r.bytes_in", "r.equal")
