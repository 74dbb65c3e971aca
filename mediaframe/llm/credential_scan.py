"""Secret scan: certain spans by pattern, weak ones only where complementary parts meet."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Fixed patterns of the certain kinds; group "v" is what must have the least length.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CERTAIN = ("assign", "access", "hex")
#: (Runs are only looked at from their start, so that time is linear in the text.)
#: Weak kinds, in the order in which ties of a span's start are listed, and their roles.
WEAK = {
    "user": ("identifier", re.compile(r"(?:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@+-]{3,})", re.IGNORECASE | re.ASCII)),
    "email": ("identifier", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+", re.ASCII)),
    "opaque": ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}", re.ASCII)),
    "endpoint": ("endpoint", re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|(?<![\w.-])[a-z0-9.-]++:\d{2,5}\b", re.ASCII)),
}
#: The host at the end of such a run: labels between single dots, two at least.
HOST = re.compile(r"[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)+\Z", re.ASCII)
KINDS = (*CERTAIN, *WEAK)
#: A certain span also plays a role that a weak one may complete.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret"} | {k: role for k, (role, _) in WEAK.items()}


def certain_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m["v"]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def endpoint_start(found: str) -> int | None:
    """Where the address begins in what the pattern has found: a URL at once, a host with a port
    after the last label that is empty."""
    if "://" in found:
        return 0
    host = found[: found.rindex(":")]
    start = host.rfind("..") + 2 if ".." in host else 0
    start += len(host[start:]) - len(host[start:].lstrip(".-"))
    return start if HOST.match(host, start) else None


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "@" in text:
        found += [("email", m.start(), m.end()) for m in WEAK["email"][1].finditer(text)]
    if ":" in text or "=" in text:
        found += [("user", m.start(), m.end()) for m in WEAK["user"][1].finditer(text)]
        for m in WEAK["endpoint"][1].finditer(text):
            if (start := endpoint_start(m[0])) is not None:
                found.append(("endpoint", m.start() + start, m.end()))
    return found + [("opaque", m.start(), m.end()) for m in WEAK["opaque"][1].finditer(text)]


SPAN = pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
SPAN_SQL = "array<struct<kind:string,a:int,b:int>>"


def _extract(texts: pa.Array) -> pa.Array:
    def rows(spans: list[tuple[str, int, int]]) -> list[dict]:
        return [{"kind": k, "a": a, "b": b} for k, a, b in spans]

    return pa.array([{"certain": rows(certain_spans(t or "")), "weak": rows(weak_spans(t or ""))} for t in texts.to_pylist()],
                    pa.struct([("certain", pa.list_(SPAN)), ("weak", pa.list_(SPAN))]))


def _rank(kind) -> F.Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _digest(spans) -> F.Column:
    """kind:start:end by start, then kind as listed."""
    by = F.array_sort(F.transform(spans, lambda s: F.struct(s["a"].alias("a"), _rank(s["kind"]).alias("r"), s["b"].alias("b"), s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(by, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))))


def link_weak(parts: DataFrame, reach: int = 256) -> DataFrame:
    """Weak spans that lie within `reach` code points of a span with a complementary role, in the
    same scope: an identifier needs a secret, a secret an identifier or an endpoint, an endpoint
    needs a secret. parts: _row, kind, a, b.

    The interval join goes by cells of `reach` code points: both sides have a key for every cell
    that they cover, the weak span with its reach, so that spans of any length meet and a key holds
    the few spans that fit into so much text.
    """
    roles = F.create_map(*[x for k, r in ROLE.items() for x in (F.lit(k), F.lit(r))])
    p = parts.withColumn("role", roles[F.col("kind")])
    left = (p.filter(~F.col("kind").isin(*CERTAIN))
            .withColumn("cell", F.explode(F.sequence(F.expr(f"div(a - {reach}, {reach}) - 1"), F.expr(f"div(b + {reach}, {reach})")))))
    right = p.select(F.col("_row").alias("r2"), F.col("role").alias("role2"), F.col("a").alias("a2"), F.col("b").alias("b2"),
                     F.explode(F.sequence(F.expr(f"div(a, {reach})"), F.expr(f"div(b, {reach})"))).alias("cell2"))
    near = ((F.col("_row") == F.col("r2")) & (F.col("cell") == F.col("cell2")) & (F.col("a2") <= F.col("b") + reach) & (F.col("b2") + reach >= F.col("a"))
            & (((F.col("role") == "secret") & F.col("role2").isin("identifier", "endpoint")) | (F.col("role").isin("identifier", "endpoint") & (F.col("role2") == "secret")))
            & ~((F.col("a2") < F.col("b")) & (F.col("b2") > F.col("a"))))
    return left.join(right.hint("merge"), near, "left_semi").select("_row", "kind", "a", "b").distinct()


def scan_credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 256) -> DataFrame:
    """id, certain and linked (arrays of kind, start, end in code points), one row for each row of docs.

    Certain spans come from the fixed patterns, leftmost and without overlap in each kind. Weak
    parts (user names, mail addresses, opaque strings, endpoints) count only if a complementary
    part lies within `reach`, and where they overlap no certain span. Null and empty texts have no
    spans; ids may repeat or be null: rows stay rows. Other columns are ignored. Only documents
    with weak parts are shuffled, without their text.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"),
                       F.arrow_udf(_extract, f"certain {SPAN_SQL}, weak {SPAN_SQL}")(F.col(text_col)).alias("x"))
    found = stage(slim.select("_id", "_row", "x.*"), "parts")
    free = F.filter("weak", lambda w: ~F.exists("certain", lambda c: (c["a"] < w["b"]) & (c["b"] > w["a"])))
    parts = found.filter(F.size("weak") > 0).select("_row", F.explode(F.concat("certain", free)).alias("s")).select("_row", "s.*")
    linked = link_weak(parts, reach).groupBy("_row").agg(F.collect_list(F.struct("kind", "a", "b")).alias("linked"))
    return (found.join(linked.hint("merge"), "_row", "left")
            .select(F.col("_id").alias(id_col), "certain", F.coalesce("linked", F.expr(f"cast(array() as {SPAN_SQL})")).alias("linked")))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    def count(kind: str) -> F.Column:
        return F.size(F.filter("certain", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(id_col, *[count(k) for k in CERTAIN], F.sha2(_digest(F.col("certain")).cast("binary"), 256).alias("base_sha256"),
                        _digest(F.concat("certain", "linked")).alias("spans"))
