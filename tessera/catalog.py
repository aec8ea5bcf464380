"""Registered queries: each operator on views of the driver tables, with its SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import genome as g
from .functions import stats
from .operators import copynum, coverage, intervals, ranges, runs, segment, signal
from .sources import writers
from .sources.views import SQL_VIEWS, bins, log2, regions, rounded, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {SQL_VIEWS} {sql}" if not sql.lstrip().startswith(",") else f"WITH {SQL_VIEWS}{sql}"
        return f

    return keep


def r6(c, name: str):
    return rounded(c, 6).alias(name)


CALLS = """, seg AS (SELECT r.*, round(log2(o.o_totalprice/100000),3) AS log2, CAST(o.o_custkey%40+1 AS BIGINT) AS probes FROM iv_regions r JOIN orders o ON o.o_orderkey=r.row_id)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with a log-ratio, taken as segments."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), rounded(log2(F.col("o_totalprice") / 100000), 3).alias("log2"), (F.col("o_custkey") % 40 + 1).alias("probes"))
    return regions(spark, sf_dir).join(o, "row_id").select("chromosome", "start", "end", "gene", "row_id", "log2", "probes")


# -- joins --------------------------------------------------------------------------------------

JOIN = "iv_bins s JOIN iv_regions q ON s.chromosome=q.chromosome"
OUTER = 's."end">q.start AND s.start<q."end"'


@query(f"""SELECT q.row_id, q.chromosome, q.start, q."end", count(*) AS n, round(sum(s.log2*s.weight)/sum(s.weight),6) AS mean_log2, round(sum(s.weight),6) AS weight
 FROM {JOIN} AND {OUTER} GROUP BY ALL""")
def rng_into_ranges_mean(spark, sf):
    pairs = ranges.range_join(regions(spark, sf), bins(spark, sf))
    flat = pairs.select("q.row_id", "q.chromosome", "q.start", "q.end", F.col("s.log2").alias("x"), F.col("s.weight").alias("w"))
    return flat.groupBy("row_id", "chromosome", "start", "end").agg(F.count("*").alias("n"), r6(stats.weighted_mean("x", "w"), "mean_log2"), r6(F.sum("w"), "weight"))


FLAGSHIP = rng_into_ranges_mean


@query(f'SELECT q.row_id AS q_id, s.row_id AS s_id FROM {JOIN} AND {OUTER}')
def rng_by_ranges_outer(spark, sf):
    return ranges.range_join(regions(spark, sf), bins(spark, sf)).select(F.col("q.row_id").alias("q_id"), F.col("s.row_id").alias("s_id"))


@query(f'SELECT q.row_id AS q_id, s.row_id AS s_id FROM {JOIN} AND s.start>=q.start AND s."end"<=q."end"')
def rng_by_ranges_inner(spark, sf):
    return ranges.range_join(regions(spark, sf), bins(spark, sf), "inner").select(F.col("q.row_id").alias("q_id"), F.col("s.row_id").alias("s_id"))


@query(f'SELECT s.row_id, s.chromosome, greatest(s.start,q.start) AS start, least(s."end",q."end") AS "end" FROM {JOIN} AND {OUTER}')
def rng_intersection_trim(spark, sf):
    return ranges.intersection(bins(spark, sf), regions(spark, sf), "trim").select("row_id", "chromosome", "start", "end")


@query('SELECT * EXCLUDE (log2, weight, depth) FROM iv_bins WHERE chromosome=\'chr5\' AND "end">100000 AND start<600000')
def rng_in_range(spark, sf):
    return ranges.in_range(bins(spark, sf), "chr5", 100000, 600000).drop("log2", "weight", "depth")


@query(f""", hits AS (SELECT q.row_id, count(*) AS n, min(s.log2) AS one, median(s.log2) AS many FROM {JOIN} AND {OUTER} GROUP BY 1)
 SELECT r.row_id, round(CASE WHEN n=1 THEN one ELSE many END,6) AS log2 FROM iv_regions r LEFT JOIN hits USING (row_id)""")
def rng_into_ranges_default(spark, sf):
    return ranges.into_ranges(bins(spark, sf), regions(spark, sf), "log2").select("row_id", r6("log2", "log2"))


@query(f""", hits AS (SELECT q.row_id, array_to_string(list_distinct(list(s.gene ORDER BY s.start)),',') AS g, count(DISTINCT s.gene) AS k FROM {JOIN} AND {OUTER} GROUP BY 1)
 SELECT row_id, k FROM hits""")
def rng_iter_ranges_of(spark, sf):
    out = ranges.values_in_ranges(bins(spark, sf), regions(spark, sf), "gene", keep_empty=False)
    return out.select("row_id", F.size(F.array_distinct("values")).cast("long").alias("k"))


MERGED = """, o AS (SELECT *, CASE WHEN start-max("end") OVER (PARTITION BY chromosome ORDER BY start,"end",row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)<=-{bp} THEN 0 ELSE 1 END AS f FROM iv_regions),
 i AS (SELECT *, sum(f) OVER (PARTITION BY chromosome ORDER BY start,"end",row_id ROWS UNBOUNDED PRECEDING) AS g FROM o),
 m AS (SELECT chromosome, g, min(start) AS start, max("end") AS "end" FROM i GROUP BY 1,2)"""


@query(MERGED.format(bp=0) + """, k AS (SELECT b.row_id, b.chromosome, b.start AS ks, b."end" AS ke, m.start AS xs, m."end" AS xe FROM iv_bins b LEFT JOIN m ON b.chromosome=m.chromosome AND m."end">b.start AND m.start<b."end"),
 w AS (SELECT *, lag(xe) OVER (PARTITION BY row_id ORDER BY xs) AS pe, lead(xs) OVER (PARTITION BY row_id ORDER BY xs) AS nx FROM k),
 p AS (SELECT row_id, chromosome, coalesce(pe,ks) AS start, coalesce(xs,ke) AS "end" FROM w UNION ALL SELECT row_id, chromosome, xe, ke FROM w WHERE nx IS NULL AND xe IS NOT NULL)
 SELECT * FROM p WHERE "end">start""")
def rng_subtract(spark, sf):
    return ranges.subtract(bins(spark, sf), regions(spark, sf)).select("row_id", "chromosome", "start", "end")


@query("""SELECT a.row_id, round(b.log2,6) AS ref_log2 FROM iv_bins a JOIN iv_bins b ON a.chromosome=b.chromosome AND a.start=b.start AND a."end"=b."end" """)
def rng_match_reference(spark, sf):
    b = bins(spark, sf)
    return ranges.match_reference(b.select("chromosome", "start", "end", "row_id"), b, ["log2"]).select("row_id", r6("ref_log2", "ref_log2"))


@query("""SELECT chromosome, CAST(sum("end"-start) AS BIGINT) AS length, any_value(n) AS mapped FROM iv_regions JOIN (SELECT chromosome, count(*) AS n FROM iv_bins GROUP BY 1) USING (chromosome) GROUP BY 1""")
def rng_update_chrom_length(spark, sf):
    counts = bins(spark, sf).groupBy("chromosome").agg(F.count("*").alias("mapped"))
    return ranges.update_chrom_length(counts, regions(spark, sf)).select("chromosome", "length", "mapped")


@query("SELECT chromosome, count(*) AS n FROM iv_bins WHERE chromosome IN (SELECT chromosome FROM iv_variants) GROUP BY 1")
def rng_shared_chroms(spark, sf):
    a, _ = ranges.shared_chroms(bins(spark, sf), variants(spark, sf))
    return a.groupBy("chromosome").agg(F.count("*").alias("n"))


@query(""", p AS (SELECT q.row_id, s.alt_freq AS f FROM iv_variants s JOIN iv_regions q ON s.chromosome=q.chromosome AND s."end">q.start AND s.start<q."end"),
 h AS (SELECT row_id, CASE WHEN count(*)=1 THEN min(f) ELSE median(0.5::DOUBLE+abs(f-0.5::DOUBLE)) END AS baf FROM p GROUP BY 1)
 SELECT r.row_id, round(baf,6) AS baf FROM iv_regions r LEFT JOIN h USING (row_id)""")
def rng_baf_by_ranges(spark, sf):
    return ranges.baf_by_ranges(variants(spark, sf), regions(spark, sf), above_half=True).select("row_id", r6("baf", "baf"))


@query("SELECT chromosome, gene, min(start) AS start, max(\"end\") AS \"end\" FROM iv_bins GROUP BY 1,2")
def rng_gene_coords(spark, sf):
    return ranges.gene_coords(bins(spark, sf))


@query(f""", b AS (SELECT *, row_number() OVER (PARTITION BY chromosome ORDER BY start,"end")-1 AS pos FROM iv_bins)
 SELECT q.row_id, min(s.pos) AS first_bin, max(s.pos)+1 AS last_bin FROM b s JOIN iv_regions q ON s.chromosome=q.chromosome AND {OUTER} GROUP BY 1""")
def rng_ranges_to_bins(spark, sf):
    return ranges.ranges_to_bins(regions(spark, sf), bins(spark, sf)).where("first_bin IS NOT NULL").select("row_id", F.col("first_bin").cast("long").alias("first_bin"), F.col("last_bin").cast("long").alias("last_bin"))


# -- interval algebra ---------------------------------------------------------------------------


@query(MERGED.format(bp=0) + ' SELECT chromosome, start, "end" FROM m')
def agg_merge(spark, sf):
    return intervals.merge(regions(spark, sf)).select("chromosome", "start", "end")


@query(MERGED.format(bp=1) + ' SELECT chromosome, start, "end" FROM m')
def agg_merge_bp1(spark, sf):
    return intervals.merge(regions(spark, sf), bp=1).select("chromosome", "start", "end")


@query(MERGED.format(bp=0) + """, pt AS (SELECT DISTINCT chromosome, g, unnest([start,"end"]) AS p FROM i), pc AS (SELECT *, lead(p) OVER (PARTITION BY chromosome,g ORDER BY p) AS e FROM pt)
 SELECT pc.chromosome, pc.p AS start, pc.e AS "end", count(*) AS probes FROM pc JOIN i ON i.chromosome=pc.chromosome AND i.g=pc.g AND i.start<=pc.p AND i."end">=pc.e WHERE pc.e IS NOT NULL GROUP BY 1,2,3""")
def agg_flatten(spark, sf):
    rows = regions(spark, sf).withColumn("probes", F.lit(1).cast("long"))
    return intervals.flatten(rows).select("chromosome", "start", "end", "probes")


@query(MERGED.format(bp=0) + """, n AS (SELECT *, greatest(CAST(round_even(("end"-start)/500::DOUBLE,0) AS BIGINT),1) AS n FROM m WHERE "end"-start>=100),
 e AS (SELECT *, unnest(range(n)) AS i FROM n)
 SELECT chromosome, start+CAST(floor(i*(CAST("end"-start AS DOUBLE)/n)) AS BIGINT) AS start, CASE WHEN i=n-1 THEN "end" ELSE start+CAST(floor((i+1)*(CAST("end"-start AS DOUBLE)/n)) AS BIGINT) END AS "end" FROM e""")
def agg_subdivide(spark, sf):
    return intervals.subdivide(regions(spark, sf), 500, 100).select("chromosome", "start", "end")


@query('SELECT row_id, chromosome, greatest(start+100,0) AS start, "end"-100 AS "end" FROM iv_regions WHERE "end"-100>start+100')
def agg_resize_shrink(spark, sf):
    return intervals.resize(regions(spark, sf), -100).select("row_id", "chromosome", "start", "end")


@query('SELECT row_id, chromosome, greatest(start-1000,0) AS start, "end"+1000 AS "end" FROM iv_regions')
def agg_resize(spark, sf):
    return intervals.resize(regions(spark, sf), 1000).select("row_id", "chromosome", "start", "end")


@query(MERGED.format(bp=1) + ' SELECT CAST(sum("end"-start) AS BIGINT) AS size FROM m')
def agg_total_range_size(spark, sf):
    return intervals.total_range_size(regions(spark, sf))


@query('SELECT chromosome, CAST(sum("end"-start) AS BIGINT) AS length FROM iv_regions GROUP BY 1')
def agg_region_size_by_chrom(spark, sf):
    return intervals.region_size_by_chrom(regions(spark, sf))


@query('SELECT chromosome, max("end") AS size FROM iv_regions GROUP BY 1')
def agg_chromosome_sizes(spark, sf):
    return intervals.chromosome_sizes(regions(spark, sf))


@query(MERGED.format(bp=0) + """, j AS (SELECT *, CASE WHEN start-lag("end") OVER (PARTITION BY chromosome ORDER BY start)<5000 THEN 0 ELSE 1 END AS f2 FROM m),
 k AS (SELECT *, sum(f2) OVER (PARTITION BY chromosome ORDER BY start) AS g2 FROM j) SELECT chromosome, min(start) AS start, max("end") AS "end" FROM k GROUP BY chromosome, g2""")
def agg_join_regions(spark, sf):
    return intervals.join_regions(intervals.merge(regions(spark, sf)).select("chromosome", "start", "end"), 5000)


@query("SELECT chromosome, 150000::BIGINT AS start, max(\"end\") AS \"end\" FROM iv_regions GROUP BY 1")
def agg_guess_chromosome_regions(spark, sf):
    return intervals.guess_chromosome_regions(regions(spark, sf))


@query(""", l AS (SELECT *, CASE WHEN log2>6 THEN 1 ELSE 0 END AS lv FROM iv_bins), c AS (SELECT *, CASE WHEN lv IS DISTINCT FROM lag(lv) OVER (PARTITION BY chromosome ORDER BY start,"end",row_id) AND row_number() OVER (PARTITION BY chromosome ORDER BY start,"end",row_id)>1 THEN 1 ELSE 0 END AS ch FROM l),
 r AS (SELECT *, sum(ch) OVER (PARTITION BY chromosome ORDER BY start,"end",row_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
 SELECT chromosome, min(start) AS start, arg_max("end",start) AS "end", round(sum(log2*weight)/sum(weight),6) AS log2, count(*) AS probes, round(sum(weight),6) AS weight FROM r GROUP BY chromosome, run""")
def agg_squash_runs(spark, sf):
    out = runs.squash(bins(spark, sf), [F.when(F.col("log2") > 6, 1).otherwise(0)])
    return out.select("chromosome", "start", "end", r6("log2", "log2"), "probes", r6("weight", "weight"))


ARMS = """, a0 AS (SELECT *, row_number() OVER (PARTITION BY chromosome ORDER BY start,"end",row_id)-1 AS rn, count(*) OVER (PARTITION BY chromosome) AS n, start-lag("end") OVER (PARTITION BY chromosome ORDER BY start,"end",row_id) AS gap FROM iv_bins),
 a1 AS (SELECT *, greatest(50,round_even(0.1::DOUBLE*n,0)) AS m FROM a0), a2 AS (SELECT chromosome, gap AS cg, rn AS cr, row_number() OVER (PARTITION BY chromosome ORDER BY gap DESC, rn) AS k FROM a1 WHERE n>2*m+1 AND rn>=m+1 AND rn<=n-m-1),
 arms AS (SELECT a1.*, CASE WHEN cg>=5000 AND rn>=cr THEN 'q' ELSE 'p' END AS arm FROM a1 LEFT JOIN a2 ON a1.chromosome=a2.chromosome AND k=1)"""


@query(ARMS + " SELECT row_id, arm FROM arms")
def agg_by_arm(spark, sf):
    return runs.by_arm(bins(spark, sf), min_gap=5000).select("row_id", "arm")


@query("SELECT chromosome, count(*) AS n, min(start) AS start, max(\"end\") AS \"end\" FROM iv_bins GROUP BY 1")
def agg_by_chromosome(spark, sf):
    return bins(spark, sf).groupBy("chromosome").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))


# -- sorts, sets --------------------------------------------------------------------------------


@query("SELECT chromosome, CASE WHEN chromosome IN ('chrX','chrY') THEN 1000 ELSE CAST(substr(chromosome,4) AS BIGINT) END AS n FROM (SELECT DISTINCT chromosome FROM iv_bins)")
def srt_chrom_key(spark, sf):
    return bins(spark, sf).select("chromosome").distinct().select("chromosome", g.chrom_key()["n"].alias("n"))


@query("SELECT chromosome, start, \"end\" FROM iv_bins")
def srt_sort(spark, sf):
    return g.sort_regions(bins(spark, sf)).select("chromosome", "start", "end")


@query("SELECT chromosome, start, \"end\" FROM iv_bins UNION ALL SELECT chromosome, start, \"end\" FROM iv_regions")
def set_concat(spark, sf):
    at = ["chromosome", "start", "end"]
    return bins(spark, sf).select(*at).unionByName(regions(spark, sf).select(*at))


@query("SELECT DISTINCT chromosome, start, \"end\" FROM iv_variants")
def set_distinct(spark, sf):
    return variants(spark, sf).select("chromosome", "start", "end").distinct()


# -- signals ------------------------------------------------------------------------------------


@query("SELECT row_id, round(log2-median(log2) OVER (PARTITION BY chromosome),6) AS residual FROM iv_bins")
def win_residuals(spark, sf):
    return signal.residuals(bins(spark, sf)).select("row_id", r6("residual", "residual"))


@query(""", z AS (SELECT row_id, 1/(1+depth) AS p FROM iv_bins), r AS (SELECT *, row_number() OVER (ORDER BY p,row_id) AS rk, count(*) OVER () AS n FROM z)
 SELECT row_id, round(least(1,min(p*n/rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)),6) AS q FROM r""")
def win_bh_adjust(spark, sf):
    rows = bins(spark, sf).select("row_id", (1 / (1 + F.col("depth"))).alias("p"))
    return signal.adjust_bh(rows).select("row_id", r6("q", "q"))


@query(""", w AS (SELECT *, CAST("end"-start AS DOUBLE) AS t, start-lag("end") OVER c AS gb, lead(start) OVER c-"end" AS ga FROM iv_bins WINDOW c AS (PARTITION BY chromosome ORDER BY start,"end",row_id)),
 e AS (SELECT *, CASE WHEN gb<250 THEN greatest(gb,0)::DOUBLE END AS b, CASE WHEN ga<250 THEN greatest(ga,0)::DOUBLE END AS a FROM w)
 SELECT row_id, round(coalesce((250-b)*(250-b)/(1000*t)-CASE WHEN t+b<250 THEN (250-t-b)*(250-t-b)/(1000*t) ELSE 0 END,0)
 +coalesce((250-a)*(250-a)/(1000*t)-CASE WHEN t+a<250 THEN (250-t-a)*(250-t-a)/(1000*t) ELSE 0 END,0)
 -(250/(2*t)-CASE WHEN t<250 THEN (250-t)*(250-t)/(500*t) ELSE 0 END),6) AS edge_bias FROM e""")
def win_edge_bias(spark, sf):
    return signal.edge_bias(bins(spark, sf)).select("row_id", r6("edge_bias", "edge_bias"))


@query("SELECT row_id, round(quantile_cont(log2,0.5::DOUBLE) OVER (PARTITION BY chromosome ORDER BY start,\"end\",row_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING),6) AS smoothed FROM iv_bins")
def win_moving_median(spark, sf):
    return signal.moving_median(bins(spark, sf), 5).select("row_id", r6("smoothed", "smoothed"))


@query("SELECT row_id, round(quantile_cont(log2,0.9::DOUBLE) OVER (PARTITION BY chromosome ORDER BY start,\"end\",row_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING),6) AS quantile FROM iv_bins")
def win_moving_quantile(spark, sf):
    return signal.moving_quantile(bins(spark, sf), 5, 0.9).select("row_id", r6("quantile", "quantile"))


@query(""", q AS (SELECT *, quantile_cont(log2,0.25::DOUBLE) OVER c AS a, quantile_cont(log2,0.5::DOUBLE) OVER c AS m, quantile_cont(log2,0.75::DOUBLE) OVER c AS b FROM iv_bins WINDOW c AS (PARTITION BY chromosome))
 SELECT row_id, abs(log2-m)>1.0*(b-a) AS is_outlier FROM q""")
def win_outlier_iqr(spark, sf):
    return signal.outliers_iqr(bins(spark, sf), c=1.0).select("row_id", "is_outlier")


@query(""", q AS (SELECT *, abs(log2-median(log2) OVER (PARTITION BY chromosome)) AS gp FROM iv_bins) SELECT row_id, gp>2.24*median(gp) OVER (PARTITION BY chromosome) AS is_outlier FROM q""")
def win_outlier_mad(spark, sf):
    return signal.outliers_mad(bins(spark, sf)).select("row_id", "is_outlier")


@query()
def win_smooth_log2(spark, sf):
    return signal.smooth_log2(bins(spark, sf))


# -- statistics ---------------------------------------------------------------------------------


@query(f""", h AS (SELECT q.row_id, sum(s.log2*s.weight)/sum(s.weight) AS mean FROM {JOIN} AND {OUTER} GROUP BY 1) SELECT r.row_id, round(mean,6) AS mean FROM iv_regions r LEFT JOIN h USING (row_id)""")
def sta_segment_mean(spark, sf):
    return copynum.segment_mean(bins(spark, sf), regions(spark, sf)).select("row_id", r6("mean", "mean"))


@query(CALLS + f""", p AS (SELECT q.row_id, s.log2 AS x, s.weight AS w, s.log2-q.log2 AS d FROM iv_bins s JOIN seg q ON s.chromosome=q.chromosome AND {OUTER}),
 h AS (SELECT row_id, sum(x*w)/sum(w) AS mean, median(x) AS median, stddev_pop(d) AS stdev, var_pop(d) AS mse, quantile_cont(d,0.75::DOUBLE)-quantile_cont(d,0.25::DOUBLE) AS iqr, quantile_cont(x,0.025::DOUBLE) AS pi_lo, quantile_cont(x,0.975::DOUBLE) AS pi_hi FROM p GROUP BY 1)
 SELECT s.row_id, round(mean,6) AS mean, round(median,6) AS median, round(stdev,6) AS stdev, round(mse,6) AS mse, round(iqr,6) AS iqr, round(pi_lo,6) AS pi_lo, round(pi_hi,6) AS pi_hi FROM seg s LEFT JOIN h USING (row_id)""")
def sta_segment_metrics(spark, sf):
    out = copynum.segment_metrics(bins(spark, sf), calls(spark, sf), ("mean", "median"), ("stdev", "mse", "iqr"), ("pi",))
    return out.select("row_id", *[r6(c, c) for c in ("mean", "median", "stdev", "mse", "iqr", "pi_lo", "pi_hi")])


@query()
def sta_segment_metrics_arrow(spark, sf):
    out = copynum.segment_metrics(bins(spark, sf), segment.segment_none(bins(spark, sf)), ("mode", "p_ttest"), ("mad", "bivar"), ("ci",))
    return out.drop("row_id")


@query(""", a AS (SELECT chromosome, avg(log2) AS m FROM iv_bins WHERE regexp_full_match(chromosome,'(chr)?[0-9]+') GROUP BY 1) SELECT row_id, round(log2-(SELECT avg(m) FROM a),6) AS log2 FROM iv_bins""")
def sta_center_all(spark, sf):
    return copynum.center_all(bins(spark, sf)).select("row_id", r6("log2", "log2"))


@query(""", a AS (SELECT chromosome, median(log2) AS m FROM iv_bins WHERE regexp_full_match(chromosome,'(chr)?[0-9]+') GROUP BY 1) SELECT row_id, round(log2-(SELECT median(m) FROM a),6) AS log2 FROM iv_bins""")
def sta_center_median(spark, sf):
    return copynum.center_all(bins(spark, sf), "median").select("row_id", r6("log2", "log2"))


@query("SELECT row_id, chromosome || ':' || CAST(start+1 AS VARCHAR) || '-' || CAST(\"end\" AS VARCHAR) AS label FROM iv_bins")
def prj_labels(spark, sf):
    return bins(spark, sf).select("row_id", g.label().alias("label"))


@query("SELECT row_id, chromosome, start, \"end\" FROM iv_bins")
def prj_from_label(spark, sf):
    return bins(spark, sf).select("row_id", g.from_label(g.label()).alias("r")).select("row_id", "r.chromosome", "r.start", "r.end")


@query("SELECT row_id FROM iv_bins WHERE regexp_full_match(chromosome,'(chr)?[0-9]+')")
def prj_autosomes(spark, sf):
    return g.autosomes(bins(spark, sf)).select("row_id")


@query("SELECT row_id, round(log2+CASE WHEN chromosome='chrX' THEN 1 ELSE 0 END,6) AS log2 FROM iv_bins")
def prj_shift_xx(spark, sf):
    return g.shift_xx(bins(spark, sf), False, False).select("row_id", r6("log2", "log2"))


@query("SELECT row_id, CASE WHEN chromosome IN ('chrX','chrY') THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS flat FROM iv_bins")
def prj_expect_flat(spark, sf):
    return bins(spark, sf).select("row_id", g.expect_flat_log2(True).alias("flat"))


@query("SELECT row_id FROM iv_bins WHERE NOT (log2 < -15 OR depth=0)")
def prj_drop_low_coverage(spark, sf):
    return g.drop_low_coverage(bins(spark, sf)).select("row_id")


@query("SELECT row_id, (log2<-5 OR log2>5 OR weight>1 OR depth=0) AS bad FROM iv_bins")
def prj_bad_bins(spark, sf):
    rows = bins(spark, sf).withColumn("spread", F.col("weight"))
    return rows.select("row_id", g.bad_bin(rows).alias("bad"))


@query(CALLS + """ SELECT row_id, CASE WHEN log2<=-1.1 THEN 0 WHEN log2<=-0.25 THEN CASE WHEN r<>2 THEN floor(1*r/2.0) ELSE 1 END WHEN log2<=0.2 THEN CASE WHEN r<>2 THEN floor(2*r/2.0) ELSE 2 END WHEN log2<=0.7 THEN CASE WHEN r<>2 THEN floor(3*r/2.0) ELSE 3 END ELSE ceil(r*pow(2,log2)) END::BIGINT AS cn
 FROM (SELECT *, CASE WHEN chromosome='chrY' THEN 1 ELSE 2 END AS r FROM seg)""")
def fun_absolute_threshold(spark, sf):
    return calls(spark, sf).select("row_id", g.absolute_threshold().alias("cn"))


@query(CALLS + " SELECT row_id, round(greatest(((CASE WHEN chromosome='chrY' THEN 1 ELSE 2 END)*pow(2,log2)-(CASE WHEN chromosome='chrY' THEN 0 ELSE 2 END)*0.4::DOUBLE)/0.6::DOUBLE,0),6) AS absolute FROM seg")
def fun_absolute_clonal(spark, sf):
    return calls(spark, sf).select("row_id", r6(g.absolute_clonal(2, 0.6, False, True), "absolute"))


@query(CALLS + " SELECT row_id, round(log2(greatest(pow(2,log2),0.001::DOUBLE))+CASE WHEN chromosome='chrY' THEN 1 ELSE 0 END,6) AS log2 FROM seg")
def fun_log2_ratios(spark, sf):
    return calls(spark, sf).select("row_id", r6(g.log2_ratios(2 * F.pow(F.lit(2.0), F.col("log2"))), "log2"))


@query("SELECT chromosome, start, round(CASE WHEN alt_freq<n_alt_freq THEN 0.5::DOUBLE*alt_freq/n_alt_freq WHEN n_alt_freq=1 THEN NULL ELSE 1-0.5::DOUBLE*(1-alt_freq)/(1-n_alt_freq) END,5) AS boosted FROM iv_variants")
def fun_tumor_boost(spark, sf):
    return variants(spark, sf).select("chromosome", "start", rounded(g.tumor_boost(F.col("alt_freq"), F.col("n_alt_freq")), 5).alias("boosted"))


@query("SELECT chromosome, start, CASE WHEN alt_freq>=0.75 THEN 1.0::DOUBLE WHEN alt_freq>=0.25 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS zygosity FROM iv_variants")
def fun_zygosity(spark, sf):
    return variants(spark, sf).select("chromosome", "start", g.zygosity(F.col("alt_freq"), 0.25, 0.75).alias("zygosity"))


@query("SELECT row_id, least(greatest(CAST(round_even(100000/depth,0) AS BIGINT),50),50000) AS bin_size FROM iv_bins WHERE depth>0")
def fun_depth_to_bin(spark, sf):
    return bins(spark, sf).where("depth > 0").select("row_id", g.depth_to_bin(F.col("depth")).alias("bin_size"))


# -- genes, segments, coverage, exports ---------------------------------------------------------


@query("SELECT chromosome, min(start) AS start, max(\"end\") AS \"end\", round(sum(log2*weight)/sum(weight),6) AS log2, count(*) AS probes FROM arms GROUP BY chromosome, arm".join([ARMS.replace("5000", "100000") + " ", ""]))
def seg_none(spark, sf):
    return segment.segment_none(bins(spark, sf)).select("chromosome", "start", "end", r6("log2", "log2"), "probes")


def _segmented(method):
    def run(spark, sf):
        return segment.segment(bins(spark, sf), method).drop("row_id")

    return run


for _m in ("haar", "ewma_haar", "cbs", "flasso", "hmm", "hmm-tumor", "hmm-germline"):
    QUERIES[f"seg_{_m.replace('-', '_')}"] = _segmented(_m)


@query(""", rd AS (SELECT chromosome, start, "end" FROM iv_bins), c AS (SELECT q.row_id, sum(least(s."end",q."end")-greatest(s.start,q.start)) AS b FROM rd s JOIN iv_regions q ON s.chromosome=q.chromosome AND s."end">q.start AND s.start<q."end" GROUP BY 1)
 SELECT r.chromosome, r.start, r."end", round(coalesce(b,0)/CAST(r."end"-r.start AS DOUBLE),6) AS depth, round(CASE WHEN b>0 THEN log2(b/CAST(r."end"-r.start AS DOUBLE)) ELSE -20 END,6) AS log2 FROM iv_regions r LEFT JOIN c USING (row_id)""")
def cov_coverage(spark, sf):
    reads = bins(spark, sf).select("chromosome", F.col("start").alias("pos"), (F.col("end") - F.col("start")).alias("aligned_len"))
    return coverage.coverage(reads, regions(spark, sf)).select("chromosome", "start", "end", r6("depth", "depth"), r6("log2", "log2"))


@query("SELECT chromosome, start, \"end\", round(CASE WHEN chromosome='chrY' THEN -1 ELSE 0 END::DOUBLE,6) AS log2, CASE WHEN chromosome='chrY' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS depth FROM iv_regions")
def ref_flat(spark, sf):
    return copynum.flat_reference(regions(spark, sf)).select("chromosome", "start", "end", "log2", "depth")


def cohort(spark, sf, n: int = 3) -> DataFrame:
    b = bins(spark, sf).drop("row_id", "weight")
    return b.withColumn("sample_id", F.explode(F.array(*[F.lit(f"s{i}") for i in range(n)]))).withColumn("log2", F.col("log2") - 6 + 0.01 * F.substring("sample_id", 2, 2).cast("int"))


@query(CALLS + " SELECT 'sample' AS \"ID\", chromosome AS chrom, start+1 AS \"loc.start\", \"end\" AS \"loc.end\", probes AS \"num.mark\", round(log2,6) AS \"seg.mean\" FROM seg")
def snk_seg(spark, sf):
    return writers.seg_table(calls(spark, sf)).withColumn("seg.mean", rounded("`seg.mean`", 6))


@query("SELECT DISTINCT chromosome || ':' || CAST(start+1 AS VARCHAR) || '-' || CAST(\"end\" AS VARCHAR) AS \"ID\", chromosome AS \"CHROM\", unnest([start+1,\"end\"]) AS \"POS\" FROM iv_bins WHERE chromosome NOT IN ('chrX','chrY')")
def snk_gistic(spark, sf):
    return writers.export_gistic_markers(bins(spark, sf))


@query(CALLS + """, c AS (SELECT *, CAST(round_even((CASE WHEN chromosome='chrY' THEN 1 ELSE 2 END)*pow(2,log2),0) AS BIGINT) AS ncopies FROM seg) SELECT chromosome, start, "end", gene AS label, ncopies FROM c WHERE ncopies<>2""")
def snk_bed(spark, sf):
    return writers.export_bed(calls(spark, sf))


@query(CALLS + """, n AS (SELECT *, dense_rank() OVER (ORDER BY CAST(substr(chromosome,4) AS INT)) AS chrm FROM seg WHERE chromosome NOT IN ('chrX','chrY'))
 SELECT 'start_' || chrm || '_' || start || ':end_' || chrm || '_' || "end" AS "#ID", CAST(chrm AS INTEGER) AS chrm, start, "end", CAST(round_even(probes*200*(pow(2,log2)*500)/100,0) AS BIGINT) AS "tumorCount", CAST(round_even(probes*200*500/100,0) AS BIGINT) AS "normalCount" FROM n""")
def snk_theta(spark, sf):
    return writers.export_theta(calls(spark, sf))


@query("SELECT chromosome, start+1 AS start, \"end\", '+' AS strand, gene FROM iv_regions")
def snk_interval(spark, sf):
    return writers.interval_table(regions(spark, sf))


