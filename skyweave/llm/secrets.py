"""Secret scans.

Fixed patterns find what has the form of a secret. For what has no known form,
two character Markov models are compared: one of random strings, one of
ordinary identifiers. A run of token characters whose log-likelihood ratio per
transition is above a threshold is a secret too.

DataFrame and SQL functions only. Texts are scanned whole; a null text is
empty. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of

# The base patterns and the least lengths of what counts.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the Markov models judge, and the characters they know.
RUN = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Ordinary identifiers, labelled by hand: names as programs have them, paths,
#: headers, long words of several languages, rulers.
ORDINARY = """
getUserName setMaxConnections max_retry_count user_account_settings is_authenticated_request configuration_manager
http-response-headers content-security-policy application/x-www-form-urlencoded src/main/java/org/example/service
createDataFrameFromRecords transactionIsolationLevel default_partition_columns internationalization-support
readBufferedInputStream parseConfigurationFile writeOutputToDirectory handleIncomingMessage updateCustomerAddress
AbstractTransactionalSpringContextTests ConcurrentLinkedQueueIterator IllegalArgumentExceptionHandler HttpServletRequestWrapper
java/util/concurrent/atomic/AtomicInteger org/apache/commons/lang/StringUtils node_modules/react/dist/production/index
usr/local/share/doc/packages/readme home/user/projects/website/static/images/background images/icons/arrow-left-small
background-color border-bottom-left-radius text-transform font-weight-normal navigation-menu-button-primary
this_is_a_very_long_variable_name another-long-identifier-with-dashes SomeVeryLongClassNameFactoryBean
test_returns_error_when_input_is_empty test_user_can_login_with_valid_credentials number_of_bytes_written_to_disk
EXPECTED_NUMBER_OF_PARTITIONS MAXIMUM_ALLOWED_PACKET_SIZE DEFAULT_CONNECTION_TIMEOUT_SECONDS ENABLE_EXPERIMENTAL_FEATURES
responsibility understanding international communication development administration characteristics environmental
investigation representation relationship notwithstanding straightforward manufacturing recommendations approximately
responsabilidad administraciones internacionales desarrollo conocimiento caracteristicas comunicaciones porque
développement internationale responsabilite gouvernement connaissances établissement certainement entreprisement
verantwortlichkeit gesellschaftliche wissenschaftlich geschwindigkeit entwicklungen zusammenarbeit verschiedenen
release-2019-stable version-2-beta chapter10section4 january2021report utf8_general_ci iso8859-1 x86_64-linux-gnu sha256sum
--------------------------------  ================================  ________________________________
"""


def samples(spark: SparkSession, n: int = 600) -> DataFrame:
    """Labelled strings ``(text, random)``: ``n`` seeded random strings in each
    of four notations (hexadecimal, base64, letters with digits, and those in
    lower case), and the ordinary identifiers above. ``n`` bounds what the models are fitted on."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    drawn = spark.range(n).select(
        F.explode(
            F.array(
                F.substring(digest, 1, 40),
                F.regexp_replace(F.base64(F.unhex(digest)), "\\s", ""),
                F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 384))), "[+/=\\s]", ""),
                F.lower(F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 512))), "[+/=\\s]", "")),
            )
        ).alias("text"),
        F.lit(True).alias("random"),
    )
    words = spark.createDataFrame([(w, False) for w in ORDINARY.split()], "text string, random boolean")
    return drawn.unionByName(words)


def train(labelled: DataFrame, backoff: float = 5.0) -> DataFrame:
    """One row ``(llr array<double>)``: for each pair of characters of
    ``ALPHABET`` in row-major order, the log-likelihood ratio, random against
    ordinary, of the second after the first. Counts are smoothed by ``backoff``
    pseudo-counts shared out as the single characters are, and those by 0.2
    each. Rows with a null text or label teach nothing."""
    size = len(ALPHABET)
    text = F.col("text")
    pairs = (
        labelled.where("text is not null and random is not null and length(text) > 1")
        .select("random", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).alias("i", "pair"))
        .select("random", F.substring("pair", 1, 1).alias("x"), F.substring("pair", 2, 1).alias("y"))
        .select("random", F.expr(f"locate(x, '{ALPHABET}') - 1").alias("x"), F.expr(f"locate(y, '{ALPHABET}') - 1").alias("y"))
        .where("x >= 0 and y >= 0")
        .groupBy("x", "y")
        .agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    )
    grid = labelled.sparkSession.range(size * size).select((F.col("id") / size).cast("int").alias("x"), (F.col("id") % size).cast("int").alias("y"))
    full = grid.join(pairs, ["x", "y"], "left").na.fill(0, ["r", "o"])
    rows = pairs.groupBy("x").agg(F.sum("r").alias("rx"), F.sum("o").alias("ox"))
    ends = pairs.groupBy("y").agg(F.sum("r").alias("ry"), F.sum("o").alias("oy"))
    full = full.join(rows, "x", "left").join(ends, "y", "left").na.fill(0, ["rx", "ox", "ry", "oy"])
    every = Window.partitionBy()
    for k in "ro":  # the sums over y count once for each x
        single = (F.col(f"{k}y") + 0.2) / (F.sum(f"{k}y").over(every) / size + 0.2 * size)
        full = full.withColumn(f"p{k}", (F.col(k) + backoff * single) / (F.col(f"{k}x") + backoff))
    ratio = F.log("pr") - F.log("po")
    return full.select((F.col("x") * size + F.col("y")).alias("i"), ratio.alias("v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("llr"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


#: Arrays are appended to in pieces of this many entries: an entry costs as
#: much in a long array as in a short one.
PIECE = 256


def _running(values: Column, zero: Column, step) -> Column:
    """Of each entry, the result of ``step`` over it and all before it;
    ``step`` is associative. Pieces are run through one by one, from what the
    pieces before come to."""
    none = F.slice(F.array(zero), 1, 0)
    grow = lambda xs, first: F.aggregate(xs, F.array(first), lambda a, v: F.concat(a, F.array(step(F.element_at(a, -1), v))))
    cut = lambda vs: F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / PIECE).cast("int")), lambda b: F.slice(vs, b * PIECE + 1, F.lit(PIECE)))
    heads = lambda pieces: grow(F.transform(pieces, lambda xs: F.aggregate(xs, zero, step)), zero)
    inner = lambda xs, before: F.when(xs.isNull(), none).otherwise(F.slice(grow(xs, before), 2, F.size(xs)))
    whole = lambda pieces: F.flatten(F.zip_with(pieces, heads(pieces), inner))
    return _let(values, lambda vs: F.when(F.size(vs) == 0, none).otherwise(_let(cut(vs), whole)))


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


SPANS = "array<struct<start:int,kind:int,end:int,m:string>>"
PLAIN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of ``(start, kind, end, m)`` of the leftmost non-overlapping
    matches. The pieces between matches and the matches themselves add up to
    the positions; ``keep`` judges a match. Time grows with the text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    parts = F.zip_with(found, between, lambda m, b: F.struct(m.alias("m"), F.length(b).alias("b")))
    placed = _let(
        F.filter(parts, lambda x: x["m"].isNotNull()),  # the last piece has no match behind it
        lambda xs: F.zip_with(
            xs,
            _running(F.transform(xs, lambda x: x["b"] + F.length(x["m"])), F.lit(0), lambda a, v: a + v),
            lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("m")),
        ),
    )
    kept = F.filter(placed, lambda s: keep(s["m"])) if keep else placed
    return F.when(F.regexp_like(text, F.lit(pattern)), kept.cast(SPANS)).otherwise(F.array().cast(SPANS))


def _free(runs: Column, base: Column) -> Column:
    """Those of ``runs`` that overlap none of ``base``. Runs are disjoint: one
    is free if nothing that starts before its end reaches beyond its start,
    which one pass over both in order tells."""
    event = lambda at, kind, s: F.struct(at.alias("at"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    events = F.sort_array(F.concat(F.transform(runs, lambda s: event(s["end"], 0, s)), F.transform(base, lambda s: event(s["start"], 1, s))))
    reach = lambda es: _running(F.transform(es, lambda e: F.when(e["kind"] == 1, e["end"]).otherwise(0)), F.lit(0), larger)
    clear = _let(events, lambda es: F.filter(F.zip_with(es, reach(es), lambda e, r: F.when((e["kind"] == 0) & (r <= e["start"]), F.struct(e["start"], F.lit(3).alias("kind"), e["end"]))), lambda s: s.isNotNull()))
    return F.when((F.size(runs) > 0) & (F.size(base) > 0), clear.cast(PLAIN)).otherwise(runs)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 1.0) -> DataFrame:
    """All of ``docs`` with ``base`` and ``spans``, arrays of
    ``(start, kind, end)`` in order; ``kind`` counts in ``KINDS``.

    ``base`` holds the fixed patterns' matches. ``spans`` adds the runs of 20
    or more token characters that overlap no base match, hold letters of both
    cases or letters and digits, and whose log-likelihood ratio is above
    ``threshold`` a transition under models trained on ``labelled(text,
    random)``. Runs of letters of one case alone are words of some language
    too often to be judged. Rows repeat as in the input; other columns stay;
    columns named ``base`` or ``spans`` are replaced. An empty table gives an
    empty result. Time grows with the length of a text, whatever it holds."""
    model = train(samples(docs.sparkSession) if labelled is None else labelled)
    llr = F.lit([float(v) for v in model.first()["llr"]])  # one number for each pair of the alphabet
    text = text_of(docs)
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    base = F.sort_array(
        plain(
            F.concat(
                _spans(text, ASSIGN, 0, value),
                _spans(text, ACCESS, 1, lambda m: F.length(m) >= 16),
                _spans(text, HEX, 2),
            )
        )
    )
    codes = F.lit([ALPHABET.find(chr(c)) for c in range(128)])

    def ratio(run: Column) -> Column:
        first = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

        def step(a: Column, c: Column) -> Column:
            code = F.element_at(codes, F.ascii(c) + 1)
            return F.struct(code.alias("last"), (a["sum"] + F.when(a["last"] < 0, 0.0).otherwise(F.element_at(llr, a["last"] * len(ALPHABET) + code + 1))).alias("sum"))

        return F.aggregate(F.split(run, ""), first, step, lambda a: a["sum"])

    def judged(run: Column) -> Column:
        mixed = (run.rlike("[0-9]") & run.rlike("[A-Za-z]")) | (run.rlike("[a-z]") & run.rlike("[A-Z]"))
        return mixed & (ratio(run) > threshold * (F.length(run) - 1))

    found = docs.withColumns({"base": base, "spans": plain(_spans(text, RUN, 3, judged))})
    return found.withColumn("spans", F.sort_array(F.concat("base", _free(F.col("spans"), F.col("base")))))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Code points in a piece of a text that is to be redacted.
CUT = 4096


def redact(docs: DataFrame, mark: str = "<secret>", **how) -> DataFrame:
    """``docs`` with ``mark`` in place of each secret; overlapping spans are
    replaced as one, and texts without secrets stay as they are. Null texts
    stay null; columns named ``base`` or ``spans`` do not survive.

    The text is cut into pieces of ``CUT`` code points, so that what stands
    between two secrets is taken from there and not counted off from the
    text's start."""
    found = scan(docs, **how)
    text = text_of(found)

    def between(pieces: Column, a: Column, b: Column) -> Column:
        one, last = F.floor(a / CUT).cast("int"), F.floor((b - 1) / CUT).cast("int")
        return F.when(b <= a, "").otherwise(F.substring(F.array_join(F.slice(pieces, one + 1, last - one + 1), ""), a - one * CUT + 1, b - a))

    ends = F.concat(F.array(F.lit(0)), _running(F.transform("spans", lambda s: s["end"]), F.lit(0), larger))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text)))
    gaps = _let(ends, lambda es: F.zip_with(starts, es, lambda s, e: F.struct(e.alias("a"), s.alias("b"))))
    # A secret that begins before those ahead of it have ended gets no mark of its own.
    marked = lambda g, i: F.when((i < F.size("spans")) & (g["b"] >= g["a"]), mark).otherwise("")
    joined = _let(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)),
        lambda pieces: F.array_join(F.transform(gaps, lambda g, i: F.concat(between(pieces, g["a"], g["b"]), marked(g, i))), ""),
    )
    clean = F.when(F.size("spans") > 0, joined).otherwise(F.col("text"))
    return found.withColumn("text", clean).drop("base", "spans")
