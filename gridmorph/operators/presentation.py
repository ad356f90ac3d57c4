"""The tables behind charts and reports, and their plain renderings."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, general, site_title, truthy
from .fractal import line_fit

#: How many sites a legend may name beside and inside a chart.
LEGEND_INSIDE, LEGEND_BESIDE = 35, 80


def head(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of an order."""
    return df.orderBy(*order).limit(n)


def legend_rule(n: Column) -> Column:
    """Where a legend of n entries goes."""
    return F.when(n <= LEGEND_INSIDE, "inside").when(n <= LEGEND_BESIDE, "outside").otherwise("suppressed")


def rank_bars(df: DataFrame, name: str, metric: str, top: int | None = None) -> DataFrame:
    """name, value of the finite metrics, the greatest ``top`` of them."""
    bars = df.select(F.col(name).alias("name"), finite(F.col(metric)).alias("value")).where("value is not null")
    return head(bars, top, F.desc("value"), F.col("name")) if top else bars


def scatter(df: DataFrame, name: str, x: str, y: str) -> DataFrame:
    """name, x, y of the rows where both are finite, and whether points are labelled."""
    points = df.select(F.col(name).alias("name"), finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).where("x is not null and y is not null")
    n = points.agg((F.count(F.lit(1)) <= LEGEND_INSIDE).alias("labelled"))
    return points.join(F.broadcast(n))  # one row


def profiles(df: DataFrame, site: str, x: str, value: str) -> DataFrame:
    """The curves of all sites with two points or more: site, x, value, value relative to the site's first, and the legend's rule."""
    rows = df.select(F.col(site).alias("site"), finite(F.col(x)).alias("x"), finite(F.col(value)).alias("value")).where("x is not null and value is not null")
    kept = rows.withColumn("points", F.count(F.lit(1)).over(Window.partitionBy("site"))).where("points >= 2").drop("points")
    first = F.first_value("value").over(Window.partitionBy("site").orderBy("x"))
    n = kept.agg(legend_rule(F.count_distinct("site")).alias("legend"))
    return kept.withColumn("relative", F.when(first != 0, F.col("value") / F.nullif(first, F.lit(0.0)))).join(F.broadcast(n))  # one row


def box_count_chart(counts: DataFrame) -> DataFrame:
    """site, x = ln(1 / scale), y = ln(count), the relative deviation over origins, and the fitted line's value."""
    fit = counts.groupBy("site").agg(*line_fit(F.ln("count_fit"), -F.ln("scale_m"))[:2])
    x = -F.ln("scale_m")
    out = counts.join(fit, "site").select("site", "bs", x.alias("x"), F.ln("count_fit").alias("y"), (F.col("count_std") / F.col("count_mean")).alias("yerr"), (F.col("intercept") + F.col("slope") * x).alias("fit"))
    return out


def mask_image(cells: DataFrame, domain: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """site, y, x, value of the whole rectangle: 1 inside the mask, 0 elsewhere in the domain, null outside it."""
    sites = domain.select("site").distinct()
    grid = sites.select("site", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))).alias("y")).select("site", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cols - 1).cast("long"))).alias("x"))
    marked = domain.select("site", "y", "x", F.lit(0).alias("d")).join(cells.select("site", "y", "x", F.lit(1).alias("m")), ["site", "y", "x"], "left")
    return grid.join(marked, ["site", "y", "x"], "left").select("site", "y", "x", F.when(F.col("d").isNotNull(), F.coalesce("m", F.lit(0))).alias("value"))


def merges_chart(merges: DataFrame) -> DataFrame:
    """A dendrogram's merges in order of height, with the bar between the two."""
    return merges.select("step", "left", "right", "height", "size", F.col("height").alias("bar")).orderBy("step")


def report_rows(documents: DataFrame) -> DataFrame:
    """The row of each document in the global report: names, plain figures, and a column for each phase, direction and figure of transport."""
    from .summary import FIELDS

    doc = F.col("doc")
    plain = {new: doc[section][old] for section, names in FIELDS.items() for new, old in names.items()}
    results = doc["two_phase_transport"]["results"]
    for phase in ("open_space", "buildings"):
        for d in ("lr", "tb"):
            last = F.try_element_at(_of(results, phase, d), F.lit(-1))
            plain |= {f"transport_{phase}_{d}_{k}": last[k] for k in ("relative_conductance", "resistance")}
    return documents.select(site_title(F.col("slug")).alias("city"), "subset", "slug", *[c.alias(k) for k, c in plain.items()])


def _of(results: Column, phase: str, direction: str) -> Column:
    return F.filter(results, lambda r: (r["phase"] == phase) & (r["direction"] == direction))


def ordered_columns(df: DataFrame, preferred: list[str]) -> DataFrame:
    """The preferred columns that are there, then the others by name."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *sorted(set(df.columns) - set(first)))


def printed(df: DataFrame) -> DataFrame:
    """All columns as text, numbers in six significant digits."""
    return df.select(*[(general(F.col(f"`{c}`")) if t in ("double", "float") else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c, t in df.dtypes])


def html_table(df: DataFrame, n: int = 50) -> str:
    """The first n rows as an HTML table, escaped."""
    rows = printed(df).limit(n).collect()  # n rows
    head_ = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head_}</tr></thead><tbody>{body}</tbody></table>"


def markdown_table(df: DataFrame, n: int = 12) -> str:
    rows = printed(df).limit(n).collect()  # n rows
    lines = [df.columns, ["-"] * len(df.columns), *[list(r) for r in rows]]
    return "\n".join("| " + " | ".join(v.replace("|", "\\|") for v in line) + " |" for line in lines)


def report(title: str, sections: dict[str, DataFrame], n: int = 50, style: str = "html") -> str:
    """A report of tables, each cut to n rows."""
    if style == "markdown":
        return "\n\n".join([f"# {title}", *[f"## {k}\n\n{markdown_table(df, n)}" for k, df in sections.items()]]) + "\n"
    body = "".join(f"<h2>{html.escape(k)}</h2>{html_table(df, n)}" for k, df in sections.items())
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}"


def passed(df: DataFrame, flag: str) -> DataFrame:
    """The rows whose flag says true, of whatever type it is."""
    return df.where(truthy(F.col(flag)))
