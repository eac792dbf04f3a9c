"""Sink payloads rendered from the ``metrics`` table.

Every renderer is a projection (JVM-side string functions, no UDF) that turns
metric rows into one payload column, so rendering runs on the executors in
the same stage that produced the rows.  Delivery (Kafka producer, HTTP bulk
endpoint, collectd exec socket, a user writer) is a separate step: see
``lagscope.sinks.runner``.

Per-sink conventions (what each target expects):

* log:      one line per metric; meters labelled ``offsetMetrics``, gauges
            ``consumerGroupOffsetMetrics``; key included.
* kafka:    JSON object per metric, no message key; ``name, timestamp, meta,
            rate1, rate5, rate15, rate_mean, count`` or ``name, timestamp,
            meta, value``; ``partition`` is a JSON number; RFC 3339 time.
* elastic:  bulk ``index`` action line + document line; zero values omitted.
* collectd: ``PUTVAL host/kafka/name-key interval=i ts:v[,ts:v...]``; meter
            values in the order count, rate1, rate5, rate15, rate_mean, ``%f``.
* influx:   line protocol, measurement = name, tags = meta as strings
            (sorted), fields ``count`` (integer) and rates, or ``value``;
            seconds precision.
* writer:   (name, timestamp, meta map<string,string>, value | count+rates),
            no key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lagscope import schemas as S
from lagscope.functions.columns import stringify_tags

KINDS = ("meter", "gauge")


def dispatch(df: DataFrame) -> DataFrame:
    """Keep only rows a sink knows how to render (meters and gauges)."""
    return df.where(F.col("kind").isin(*KINDS))


def by_kind(df: DataFrame, meter, gauge) -> DataFrame:
    """Meters and gauges rendered apart, so that each row only goes through
    the projections of its kind; where ``df`` is a union of the two, the
    optimizer reads each side once."""
    return meter(df.where(F.col("kind") == "meter")).unionByName(gauge(df.where(F.col("kind") == "gauge")))


# --- formatting helpers ---------------------------------------------------------

def rfc3339(ts: str | Column) -> Column:
    """``2024-01-01T00:01:30Z``; fractional seconds printed without trailing zeros."""
    c = F.col(ts) if isinstance(ts, str) else ts
    frac = F.regexp_replace(F.date_format(c, "SSSSSS"), "0+$", "")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                    F.lit("Z"))


def go_time_string(ts: str | Column) -> Column:
    """``2024-01-01 00:01:30 +0000 UTC`` (the default text form of a UTC time)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    frac = F.regexp_replace(F.date_format(c, "SSSSSS"), "0+$", "")
    return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
                    F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                    F.lit(" +0000 UTC"))


def with_float_text(df: DataFrame, cols: list[str], json_style: bool = True,
                    suffix: str = "__txt") -> DataFrame:
    """Add ``<col>__txt``: the shortest round-trip decimal text of each double,
    without exponent where possible (``12``, ``0.000277``, ``-4.5``).  With
    ``json_style`` values below 1e-6 or from 1e21 use ``d.ddde-7`` form.
    Non-finite values give null.

    The digits come from ``cast(x as string)`` (shortest repr) and the decimal
    point is re-placed.  Each step is its own projection so intermediate
    strings are computed once per row (the optimizer does not inline a
    non-trivial expression that is referenced several times).
    """
    keep = [F.col(c) for c in df.columns]

    def stage(exprs):
        nonlocal df
        df = df.select(*[F.col(c) for c in df.columns], *exprs)

    t = {c: f"__f_{c}" for c in cols}
    stage([F.regexp_replace(F.col(c).cast("string"), "^-", "").alias(t[c] + "a") for c in cols]
          + [F.col(c).cast("string").startswith("-").alias(t[c] + "neg") for c in cols])
    stage([F.when(F.col(t[c] + "a").contains("E"), F.substring_index(t[c] + "a", "E", 1))
           .otherwise(F.col(t[c] + "a")).alias(t[c] + "m") for c in cols]
          + [F.when(F.col(t[c] + "a").contains("E"), F.substring_index(t[c] + "a", "E", -1).cast("int"))
             .otherwise(F.lit(0)).alias(t[c] + "e") for c in cols])
    stage([F.concat(F.substring_index(t[c] + "m", ".", 1),
                    F.when(F.col(t[c] + "m").contains("."), F.substring_index(t[c] + "m", ".", -1))
                    .otherwise(F.lit(""))).alias(t[c] + "raw") for c in cols]
          + [(F.length(F.substring_index(t[c] + "m", ".", 1)) + F.col(t[c] + "e")).alias(t[c] + "p0")
             for c in cols])
    stage([F.regexp_replace(t[c] + "raw", "^0+", "").alias(t[c] + "st") for c in cols])
    stage([F.regexp_replace(t[c] + "st", "0+$", "").alias(t[c] + "d") for c in cols]
          + [(F.col(t[c] + "p0") - F.length(t[c] + "raw") + F.length(t[c] + "st")).alias(t[c] + "p")
             for c in cols])
    out = []
    for c in cols:
        d, p, neg, x = F.col(t[c] + "d"), F.col(t[c] + "p"), F.col(t[c] + "neg"), F.col(c)
        nd = F.length(d)
        fixed = (F.when(p <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d))
                 .when(p >= nd, F.concat(d, F.repeat(F.lit("0"), p - nd)))
                 .otherwise(F.concat(F.substring(d, 1, p), F.lit("."), _substr_from(d, p + 1))))
        e = p - 1
        sci = F.concat(
            F.substring(d, 1, 1),
            F.when(nd > 1, F.concat(F.lit("."), _substr_from(d, 2))).otherwise(F.lit("")),
            F.lit("e"),
            F.when(e < 0, F.concat(F.lit("-"), F.abs(e).cast("string")))
            # at least two exponent digits; lpad alone would cut longer ones
            .otherwise(F.concat(F.lit("+"), F.when(e < 10, F.lpad(e.cast("string"), 2, "0"))
                                .otherwise(e.cast("string")))))
        ax = F.abs(x)
        use_sci = ((ax < 1e-6) | (ax >= 1e21)) if json_style else F.lit(False)
        body = F.when(d == "", F.lit("0")).when(use_sci, sci).otherwise(fixed)
        txt = F.concat(F.when(neg & (d != ""), F.lit("-")).otherwise(F.lit("")), body)
        finite = x.isNotNull() & ~F.isnan(x) & (ax != float("inf"))
        out.append(F.when(finite, txt).alias(c + suffix))
    return df.select(*keep, *out)


def _substr_from(s: Column, pos) -> Column:
    """Suffix of ``s`` starting at 1-based ``pos`` (Column or int)."""
    p = pos if isinstance(pos, Column) else F.lit(pos)
    return F.call_function("substr", s, p)


RATE_COLS = ["rate1", "rate5", "rate15", "rate_mean"]


def tag_string(sep: str, eq: str, escape=None) -> Column:
    """Meta as ``group<eq>g<sep>partition<eq>0<sep>topic<eq>t``: the fixed meta
    fields in name order, absent (null or empty) ones left out.  Built with
    ``concat_ws`` (codegen) rather than higher-order functions over a map."""
    esc = escape or (lambda c: c)
    parts = []
    for name, c in (("group", F.col("meta.group")),
                    ("partition", F.col("meta.partition").cast("string")),
                    ("topic", F.col("meta.topic"))):
        parts.append(F.when(c.isNotNull() & (c != ""),
                            F.concat(esc(F.lit(name)), F.lit(eq), esc(c))))
    return F.concat_ws(sep, *parts)


def _meta_json_struct() -> Column:
    # Go encodes map keys in sorted order: group, partition, topic; absent keys are nulls
    # that to_json drops.
    return F.struct(F.col("meta.group").alias("group"), F.col("meta.partition").alias("partition"),
                    F.col("meta.topic").alias("topic"))


# --- renderers ------------------------------------------------------------------

def log_lines(df: DataFrame) -> DataFrame:
    tags = tag_string(" ", ":")
    base = F.concat(F.lit("{BaseMetric:{Name:"), F.col("name"), F.lit(" Key:"), F.col("key"),
                    F.lit(" Timestamp:"), go_time_string("timestamp"),
                    F.lit(" Meta:map["), tags, F.lit("]} "))
    meter = F.concat(F.lit(S.LOG_METER_LABEL + " "), base,
                     F.lit("Meter:{Count:"), F.col("count").cast("string"),
                     F.lit(" Rate1:"), F.coalesce(F.col("rate1__txt"), F.lit("NaN")),
                     F.lit(" Rate5:"), F.coalesce(F.col("rate5__txt"), F.lit("NaN")),
                     F.lit(" Rate15:"), F.coalesce(F.col("rate15__txt"), F.lit("NaN")),
                     F.lit(" RateMean:"), F.coalesce(F.col("rate_mean__txt"), F.lit("NaN")),
                     F.lit("}}"))
    gauge = F.concat(F.lit(S.LOG_GAUGE_LABEL + " "), base, F.lit("Gauge:"),
                     F.col("value").cast("string"), F.lit("}"))
    return by_kind(df, lambda m: with_float_text(m, RATE_COLS).select(meter.alias("line")),
                   lambda g: g.select(gauge.alias("line")))


def _json_object(pairs: list[tuple[str, Column]]) -> Column:
    """``{"k":v,...}`` in the given key order; entries whose text is null are
    left out.  ``<``, ``>``, ``&`` and U+2028/U+2029 are written as \\u escapes,
    as the JSON encoder of the original sinks does (they can only occur inside
    string values here, so replacing them in the whole object is safe)."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in pairs]
    obj = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    for ch, esc in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"),
                    ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        obj = F.replace(obj, F.lit(ch), F.lit(esc))
    return obj


def _json_text(c: str) -> Column:
    """The string as JSON, whatever its length; null (no entry) for null."""
    return F.when(F.col(c).isNotNull(),
                  F.regexp_replace(_substr_from(F.to_json(F.struct(F.col(c).alias("v"))), 6), "}$", ""))


def _meta_json() -> Column:
    return F.to_json(_meta_json_struct())


def kafka_json(df: DataFrame, topic: str = S.DEFAULT_TOPIC) -> DataFrame:
    """``(topic, value)`` rows ready for ``write.format('kafka')``; no key."""
    name = _json_text("name")
    ts = F.concat(F.lit('"'), rfc3339("timestamp"), F.lit('"'))
    meter = _json_object([
        ("name", name), ("timestamp", ts), ("meta", _meta_json()),
        ("rate1", F.col("rate1__txt")), ("rate5", F.col("rate5__txt")),
        ("rate15", F.col("rate15__txt")), ("rate_mean", F.col("rate_mean__txt")),
        ("count", F.col("count").cast("string")),
    ])
    gauge = _json_object([("name", name), ("timestamp", ts), ("meta", _meta_json()),
                          ("value", F.col("value").cast("string"))])
    return by_kind(df, lambda m: with_float_text(m, RATE_COLS).select(F.lit(topic).alias("topic"), meter.alias("value")),
                   lambda g: g.select(F.lit(topic).alias("topic"), gauge.alias("value")))


def elasticsearch_docs(df: DataFrame, index: str = S.DEFAULT_INDEX,
                       doc_type: str = S.DEFAULT_DOC_TYPE) -> DataFrame:
    """Bulk API NDJSON: one ``index`` action line and one document line per
    metric; zero numbers and empty names are omitted from the document."""
    name = _json_text("name")
    ts = F.concat(F.lit('"'), rfc3339("timestamp"), F.lit('"'))

    def nz(c: str, text: Column) -> Column:
        return F.when(F.col(c) != 0, text)

    meter = _json_object([
        ("name", F.when(F.col("name") != "", name)), ("timestamp", ts), ("meta", _meta_json()),
        ("rate1", nz("rate1", F.col("rate1__txt"))),
        ("rate5", nz("rate5", F.col("rate5__txt"))),
        ("rate15", nz("rate15", F.col("rate15__txt"))),
        ("rate_mean", nz("rate_mean", F.col("rate_mean__txt"))),
        ("count", nz("count", F.col("count").cast("string"))),
    ])
    gauge = _json_object([("name", F.when(F.col("name") != "", name)), ("timestamp", ts),
                          ("meta", _meta_json()), ("value", nz("value", F.col("value").cast("string")))])
    action = F.lit('{"index":{"_index":"%s","_type":"%s"}}' % (index, doc_type))
    return by_kind(
        df, lambda m: with_float_text(m, RATE_COLS).select(action.alias("action"), meter.alias("document")),
        lambda g: g.select(action.alias("action"), gauge.alias("document")))


def collectd_lines(df: DataFrame, hostname: str = "localhost",
                   interval: str | int = S.DEFAULT_INTERVAL_SECONDS) -> DataFrame:
    ts = F.unix_seconds("timestamp").cast("string")
    head = F.concat(F.lit(f"PUTVAL {hostname}/kafka/"), F.col("name"), F.lit("-"), F.col("key"),
                    F.lit(f" interval={interval} "))

    def pv(v: Column) -> Column:
        return F.concat(ts, F.lit(":"), v)

    def f6(c: str) -> Column:
        # collectd's "unknown value" marker where the rate is undefined
        return F.when(F.col(c).isNotNull(), F.format_string("%f", F.col(c))).otherwise(F.lit("U"))

    meter = F.concat(head, F.concat_ws(",", pv(F.col("count").cast("string")), pv(f6("rate1")),
                                       pv(f6("rate5")), pv(f6("rate15")), pv(f6("rate_mean"))))
    gauge = F.concat(head, pv(F.col("value").cast("string")))
    return by_kind(df, lambda m: m.select(meter.alias("line")), lambda g: g.select(gauge.alias("line")))


def _influx_escape(c: Column, chars: str) -> Column:
    out = c
    for ch in chars:
        out = F.regexp_replace(out, "\\" + ch if ch != " " else " ", "\\\\" + ch)
    return out


def influx_lines(df: DataFrame) -> DataFrame:
    """Line protocol with second precision (``database``/``retention`` are
    request parameters of the writer, not part of the line)."""
    measurement = _influx_escape(F.col("name"), ", ")
    tags = tag_string(",", "=", lambda c: _influx_escape(c, ",= "))
    key = F.concat(measurement, F.when(tags != "", F.concat(F.lit(","), tags)).otherwise(F.lit("")))

    def fld(name: str, v: Column) -> Column:
        return F.when(v.isNotNull(), F.concat(F.lit(name + "="), v))

    # fields sorted by name: count, rate1, rate15, rate5, rate_mean
    meter = F.concat_ws(",", fld("count", F.concat(F.col("count").cast("string"), F.lit("i"))),
                        fld("rate1", F.col("rate1__txt")),
                        fld("rate15", F.col("rate15__txt")),
                        fld("rate5", F.col("rate5__txt")),
                        fld("rate_mean", F.col("rate_mean__txt")))
    gauge = fld("value", F.concat(F.col("value").cast("string"), F.lit("i")))

    def line(fields: Column) -> Column:
        return F.concat_ws(" ", key, fields, F.unix_seconds("timestamp").cast("string")).alias("line")

    return by_kind(df, lambda m: with_float_text(m, RATE_COLS, json_style=False).select(line(meter)),
                   lambda g: g.select(line(gauge)))


def writer_records(df: DataFrame) -> DataFrame:
    """Rows handed to a user writer: no key, meta as ``map<string,string>``."""
    df = dispatch(df)
    return df.select("kind", "name", "timestamp", stringify_tags("meta").alias("meta"),
                     "value", "count", "rate1", "rate5", "rate15", "rate_mean")
