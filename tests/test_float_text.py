"""Go-style shortest float text (JSON and line-protocol forms) against a
Python reference built on repr(), which is the shortest round-trip form."""

from decimal import Decimal

from hypothesis import Phase, given, settings, strategies as st

from lagscope.sinks.render import with_float_text


def go_fixed(x: float) -> str:
    d = Decimal(repr(x))
    s = format(d, "f")
    if "." in s:
        s = s.rstrip("0").rstrip(".")
    return "0" if s in ("-0", "") else s


def go_json_from_digits(x: float) -> str:
    """``d.ddde-7`` form with the shortest digits (exponent sign always,
    two digits when positive)."""
    t = Decimal(repr(x)).normalize()
    sign, digits, exp = t.as_tuple()
    ds = "".join(map(str, digits))
    e = len(ds) - 1 + exp
    m = ds[0] + ("." + ds[1:] if len(ds) > 1 else "")
    return ("-" if sign else "") + f"{m}e{'-' if e < 0 else '+'}{abs(e) if e < 0 else f'{e:02d}'}"


finite = st.floats(allow_nan=False, allow_infinity=False, width=64)


@settings(max_examples=5, deadline=None, phases=[Phase.generate])
@given(st.lists(finite, min_size=300, max_size=300))
def test_float_text_matches_reference(spark, xs):
    """Always: the text parses back to the same double and uses the fixed /
    exponent form Go would choose.  Byte-exact digits need a JVM whose
    Double.toString is shortest (JDK 19+); JDK 17 prints an extra digit for
    a few values."""
    xs = xs + [0.0, 12.0, 0.000277, 2.77e-7, 1e21, 123456789.125, 1e-6, 9.999999e-7, -4.5,
               -2.6412757827758165e+175]
    df = spark.createDataFrame([(x, x) for x in xs], "a double, b double")
    rows = with_float_text(with_float_text(df, ["a"]), ["b"], json_style=False, suffix="__f").collect()
    jdk = int(spark.sparkContext._jvm.System.getProperty("java.version").split(".")[0])
    for r in rows:
        x = r["a"]
        sci = x != 0 and (abs(x) < 1e-6 or abs(x) >= 1e21)
        want_j = go_json_from_digits(x) if sci else go_fixed(x)
        got_j, got_f = r["a__txt"], r["b__f"]
        assert float(got_j) == x and float(got_f) == x, (x, got_j, got_f)
        assert ("e" in got_j) == sci and "e" not in got_f, (x, got_j, got_f)
        if sci:
            assert got_j.split("e")[1] == want_j.split("e")[1], (x, got_j, want_j)
        if jdk >= 19:
            assert (got_j, got_f) == (want_j, go_fixed(x)), (x, got_j, want_j)
