"""Spectral fixtures derived from the provided test tables.

The test tables have no spectra, so ``embeddings`` stands in for them (64 bands
mapped to a reflectance-like 0.23..0.73 range, five datasets from ``label``) and
``lineitem`` feeds the prediction-record, run-log and tabular fixtures with
volume.  Each fixture exists twice: as a Spark DataFrame builder and as a DuckDB
CTE, defining the same rows.  float32 inputs are cast to double before any
arithmetic so that both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

N_BANDS = 64


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read a test table.  ``spread``: a single-row-group file scans as one task; for
    the row-heavy fixtures spread it over the default parallelism (round robin).
    Inputs that already scan as many partitions are left untouched."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if spread:
        par = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < par:
            df = df.repartition(par)
    return df


# ---------------------------------------------------------------- Spark side

def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, sample_id, spectrum ARRAY<DOUBLE>, target)."""
    return spark.sql(
        """
        with s as (select concat('T', cast(1 + label % 5 as string)) as dataset, vec_id as sample_id,
          transform(embedding, e -> 0.5D + 0.5D * cast(e as double)) as spectrum from {emb})
        select *, 20D + 40D*spectrum[5] - 25D*spectrum[20] + 30D*spectrum[40]*spectrum[50]
          + 2D*((sample_id*7919) % 101)/101D as target from s
        """,
        emb=table(spark, sf_dir, "embeddings"),
    )


def bands(spark: SparkSession, n: int = N_BANDS) -> DataFrame:
    """(band INT, wavelength DOUBLE): 410..2490 nm on an integer grid."""
    return spark.sql(
        f"select cast(id as int) as band, round(410D + id*2080D/{n - 1}D) as wavelength from range({n})")


def spectra_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.sources.schema import spectrum_to_long
    return spectrum_to_long(spectra(spark, sf_dir), bands(spark))


def spectra_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra with injected nulls, zeros and null targets."""
    return spark.sql(
        """
        select dataset, sample_id, transform(spectrum, (x, i) -> case when (sample_id*31 + i) % 97 = 0 then cast(null as double)
          when (sample_id*17 + i) % 89 = 0 then 0D else x end) as spectrum,
          case when sample_id % 53 = 0 then cast(null as double) else target end as target from {s}
        """,
        s=spectra(spark, sf_dir),
    )


def spectra_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra(spark, sf_dir)
    return s.unionAll(s.where("sample_id % 50 = 0"))


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold prediction records, one per lineitem row, with failed folds."""
    return spark.sql(
        """
        select concat('T', cast(1 + l_suppkey % 5 as string)) as dataset,
          case l_returnflag when 'A' then 'Absorbance' when 'N' then 'Reflectance' else 'Continuum Removal' end as preprocessing,
          element_at(array('pls','rf','gbr','svr','krr'), cast(1 + l_partkey % 5 as int)) as model,
          cast((l_orderkey*7 + l_linenumber) % 5 as int) as fold, l_orderkey*10 + l_linenumber as sample_id,
          l_extendedprice/1000D as y_true,
          case when l_suppkey % 5 = 2 and l_partkey % 5 = 3 and (l_orderkey*7 + l_linenumber) % 5 = 1 then cast(null as double)
            else l_extendedprice/1000D*(0.8D + 0.03D*(l_partkey % 5)) + ((l_orderkey*13) % 17 - 8)*0.5D end as y_pred
        from {li}
        """,
        li=table(spark, sf_dir, "lineitem"),
    )


def run_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, line): run-log text with some malformed lines."""
    return spark.sql(
        """
        select concat('T', cast(1 + l_suppkey % 5 as string)) as dataset,
          case when l_orderkey % 23 = 0 then 'warning: no score' else concat(
            element_at(array('Reflectance','Absorbance','Continuum Removal'), cast(1 + l_partkey % 3 as int)), '_',
            element_at(array('pls','rf','gbr','svr','krr'), cast(1 + l_orderkey % 5 as int)), ': R2=0.',
            lpad(cast((l_orderkey*31 + l_partkey*7) % 10000 as string), 4, '0'), ', RMSE=', cast(1 + l_partkey % 9 as string), '.',
            lpad(cast((l_partkey*37) % 10000 as string), 4, '0')) end as line
        from {li}
        """,
        li=table(spark, sf_dir, "lineitem"),
    )


def tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, sample_id, spectrum, target): wide-numeric rows at volume."""
    return spark.sql(
        """
        select concat('T', cast(1 + l_suppkey % 5 as string)) as dataset, l_orderkey*10 + l_linenumber as sample_id,
          array(l_quantity, l_discount, l_tax, cast(l_partkey % 200 as double)) as spectrum,
          l_extendedprice as target from {li}
        """,
        li=table(spark, sf_dir, "lineitem"),
    )


# ---------------------------------------------------------------- DuckDB side
# CTE bodies for the oracle SQL; views embeddings/lineitem are pre-registered.

DUCK = {
    "spectra": """
        select *, 20::double + 40::double*spectrum[6] - 25::double*spectrum[21] + 30::double*spectrum[41]*spectrum[51]
          + 2::double*((sample_id*7919) % 101)/101::double as target
        from (select 'T' || cast(1 + label % 5 as varchar) as dataset, vec_id as sample_id,
          list_transform(embedding, lambda e: 0.5::double + 0.5::double * cast(e as double)) as spectrum from embeddings)""",
    "bands": f"""
        select cast(range as int) as band, round(410::double + range*2080::double/{N_BANDS - 1}::double) as wavelength
        from range({N_BANDS})""",
    "spectra_long": """
        select s.dataset, s.sample_id, cast(s.band as int) as band, b.wavelength, s.value, s.target
        from (select dataset, sample_id, target, generate_subscripts(spectrum, 1) - 1 as band, unnest(spectrum) as value
              from spectra) s join bands b on s.band = b.band""",
    "spectra_dirty": """
        select dataset, sample_id, list_transform(spectrum, lambda x, i: case when (sample_id*31 + i - 1) % 97 = 0 then cast(null as double)
          when (sample_id*17 + i - 1) % 89 = 0 then 0::double else x end) as spectrum,
          case when sample_id % 53 = 0 then cast(null as double) else target end as target from spectra""",
    "spectra_dup": """
        select * from spectra union all select * from spectra where sample_id % 50 = 0""",
    "oof": """
        select 'T' || cast(1 + l_suppkey % 5 as varchar) as dataset,
          case l_returnflag when 'A' then 'Absorbance' when 'N' then 'Reflectance' else 'Continuum Removal' end as preprocessing,
          (['pls','rf','gbr','svr','krr'])[1 + l_partkey % 5] as model,
          cast((l_orderkey*7 + l_linenumber) % 5 as int) as fold, l_orderkey*10 + l_linenumber as sample_id,
          l_extendedprice/1000::double as y_true,
          case when l_suppkey % 5 = 2 and l_partkey % 5 = 3 and (l_orderkey*7 + l_linenumber) % 5 = 1 then cast(null as double)
            else l_extendedprice/1000::double*(0.8::double + 0.03::double*(l_partkey % 5)) + ((l_orderkey*13) % 17 - 8)*0.5::double end as y_pred
        from lineitem""",
    "run_log_lines": """
        select 'T' || cast(1 + l_suppkey % 5 as varchar) as dataset,
          case when l_orderkey % 23 = 0 then 'warning: no score' else
            (['Reflectance','Absorbance','Continuum Removal'])[1 + l_partkey % 3] || '_' ||
            (['pls','rf','gbr','svr','krr'])[1 + l_orderkey % 5] || ': R2=0.' ||
            lpad(cast((l_orderkey*31 + l_partkey*7) % 10000 as varchar), 4, '0') || ', RMSE=' || cast(1 + l_partkey % 9 as varchar) || '.' ||
            lpad(cast((l_partkey*37) % 10000 as varchar), 4, '0') end as line
        from lineitem""",
    "tabular": """
        select 'T' || cast(1 + l_suppkey % 5 as varchar) as dataset, l_orderkey*10 + l_linenumber as sample_id,
          [l_quantity, l_discount, l_tax, cast(l_partkey % 200 as double)] as spectrum, l_extendedprice as target
        from lineitem""",
}

# fixture -> fixtures it reads (so a query's SQL carries exactly the CTEs it needs)
DUCK_DEPS = {
    "spectra": [], "bands": [], "spectra_long": ["spectra", "bands"], "spectra_dirty": ["spectra"],
    "spectra_dup": ["spectra"], "oof": [], "run_log_lines": [], "tabular": [],
}


def duck_with(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the DuckDB CTEs for the named fixtures (and extra CTEs)."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DUCK_DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} as ({DUCK[n]})" for n in order] + [f"{n} as ({q})" for n, q in (extra or [])]
    return ("with " + ",\n".join(ctes) + "\n" + body) if ctes else body
