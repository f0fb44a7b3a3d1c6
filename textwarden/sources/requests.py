"""Texts out of JSON requests and responses, and the pure parts of request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BODY_BYTES = 1 << 20
# Fields that may hold a prompt, in order.
PROMPT_FIELDS = ("prompt", "content", "text", "input", "query")
ROLES = ("system", "user", "assistant", "tool", "function")
KNOWN_FIELDS = ("model", "messages", "temperature", "max_tokens", "stream")
TOOL_FIELDS = ("tools", "tool_choice", "functions", "function_call")
# Private networks.
PRIVATE_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "::1/128", "fc00::/7")
#: The IPv6 ones as patterns over an address's text, in lower case.
_SIX = {"::1/128": r"^[0:]*:(0{0,3}1|0[.]0[.]0[.]1)$", "fc00::/7": "^f[cd][0-9a-f]{2}:"}


TOO_LARGE = 413


def fits(body: Column) -> Column:
    return F.octet_length(body) <= MAX_BODY_BYTES


def inspected(df: DataFrame, body: str = "body", method: str | None = None, content_type: str | None = None, length: str | None = None, session: str | None = None) -> DataFrame:
    """Every request stays a row. Adds status (413 for a body, or an announced length, over the limit, else null), prompt and session_id.

    Only POST and PUT of JSON are read; others, as bodies without a prompt, keep a null prompt and pass. The session is
    the named column's, else the body's "session_id", else a new one; rows without a prompt have none. A refused body is not kept.
    """
    b = F.col(body)
    read = F.lit(True)
    if method:
        read &= F.coalesce(F.col(method).isin("POST", "PUT"), F.lit(False))
    if content_type:
        read &= F.coalesce(F.contains(content_type, F.lit("application/json")), F.lit(False))
    large = ~fits(b)
    if length:
        large = large | F.coalesce(F.col(length).try_cast("long") > MAX_BODY_BYTES, F.lit(False))
    out = df.withColumn("status", F.when(read & large, TOO_LARGE)).withColumn(body, F.when(F.col("status").isNull(), b))
    out = out.withColumn("prompt", F.when(read, F.nullif(prompt_text(F.col(body)), F.lit(""))))
    own = [F.nullif(F.col(session).cast("string"), F.lit(""))] if session else []
    known = F.coalesce(*own, F.nullif(F.get_json_object(body, "$.session_id"), F.lit("")), F.uuid())
    return out.withColumn("session_id", F.when(F.col("prompt").isNotNull(), known))


def _items(body: Column, path: str) -> Column:
    """A JSON list as array of JSON strings; null if it is none."""
    raw = F.get_json_object(body, path)
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>"))


def prompt_text(body: Column) -> Column:
    """All contents of "messages" if that is a list (flat fields are not tried then), else the first string among the prompt fields."""
    parts = F.filter(F.transform(_items(body, "$.messages"), lambda m: F.get_json_object(m, "$.content")), lambda x: x.isNotNull())
    joined = F.when(F.size(parts) > 0, F.array_join(parts, " "))
    kinds = F.from_json(body, "map<string,string>")
    flat = F.coalesce(*[F.when(_is_string(body, f), kinds[f]) for f in PROMPT_FIELDS])
    return F.when(_items(body, "$.messages").isNotNull(), joined).otherwise(flat)


def _is_string(body: Column, field: str) -> Column:
    """Whether a top-level field is a JSON string: as a variant it has that type."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant")) == "STRING"


def chat_prompt(messages: Column) -> Column:
    """Contents of user and system turns. messages: array<struct<role, content>>."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"].isin("user", "system")), lambda m: m["content"]), " ")


def completion_prompt(body: Column) -> Column:
    """The prompt of a completion request, whatever its type, as text."""
    return F.get_json_object(body, "$.prompt")


def response_text(body: Column) -> Column:
    """choices[0].message.content where there is a message, else choices[0].text."""
    first = "$.choices[0]"
    return F.when(F.get_json_object(body, f"{first}.message").isNotNull(), F.get_json_object(body, f"{first}.message.content")).otherwise(F.get_json_object(body, f"{first}.text"))


def valid_chat_request(body: Column) -> Column:
    """Model and messages are there, and every message has a known role and a content."""
    bad = F.exists(_items(body, "$.messages"), lambda m: ~F.coalesce(F.get_json_object(m, "$.role"), F.lit("")).isin(*ROLES) | F.get_json_object(m, "$.content").isNull())
    return F.coalesce(F.get_json_object(body, "$.model").isNotNull() & _items(body, "$.messages").isNotNull() & ~bad, F.lit(False))


def extra_fields(body: Column) -> Column:
    keys = F.json_object_keys(body)
    return F.array_sort(F.array_except(keys, F.array(*map(F.lit, KNOWN_FIELDS))))


def tool_fields(body: Column) -> Column:
    return F.array_sort(F.array_intersect(F.json_object_keys(body), F.array(*map(F.lit, TOOL_FIELDS))))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    parts = F.split(ip, r"\.")
    octets = [F.try_element_at(parts, F.lit(k)).cast("string").try_cast("int") for k in range(1, 5)]
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}\z") & (F.greatest(*octets) <= 255)
    return F.when(ok, sum((o.cast("long") * (256 ** (3 - k)) for k, o in enumerate(octets)), F.lit(0).cast("long")))


def _four() -> list[tuple[str, int, int]]:
    """(network, first, last address) of the IPv4 networks."""
    out = []
    for n in (n for n in PRIVATE_NETWORKS if n not in _SIX):
        base, bits = n.split("/")
        low = sum(int(x) << (24 - 8 * k) for k, x in enumerate(base.split(".")))
        out.append((n, low, low + (1 << (32 - int(bits))) - 1))
    return out


def networks(spark: SparkSession) -> DataFrame:
    """The IPv4 networks as ranges of address numbers."""
    return spark.createDataFrame(_four(), "network string, low long, high long")


def private_network(ip: Column) -> Column:
    """The private network an address (IPv4 or IPv6, without brackets) lies in, null if in none: conditions, no join."""
    n, text = ip_number(ip), F.lower(ip)
    out: Column = F.lit(None).cast("string")
    for net, low, high in reversed(_four()):
        out = F.when(n.between(low, high), net).otherwise(out)
    for net, pattern in reversed(_SIX.items()):
        out = F.when(text.contains(":") & text.rlike(pattern), net).otherwise(out)
    return out


def upstream_allowed(url: Column) -> Column:
    """Scheme http(s), a host, and no private address; IPv6 addresses stand in brackets. Names are not looked up."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#\[\]]+)", 1)
    bare = F.regexp_replace(F.regexp_replace(host, r"^\[|\]$", ""), "%.*$", "")
    return F.coalesce(scheme.isin("http", "https") & (bare != "") & (F.lower(bare) != "localhost") & private_network(bare).isNull(), F.lit(False))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (path, text); a .json file gives its first non-empty prompt, content or text, or itself."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    inner = F.coalesce(*[F.nullif(F.get_json_object("raw", f"$.{f}"), F.lit("")) for f in ("prompt", "content", "text")])
    return rows.select("path", F.when(F.col("path").endswith(".json"), F.coalesce(inner, "raw")).otherwise(F.col("raw")).alias("text"))


def body_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON request bodies, one a line, as a stream of (body, status, prompt, session_id); see ``inspected``."""
    return inspected(spark.readStream.text(path).select(F.col("value").alias("body")))
