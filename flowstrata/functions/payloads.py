"""Service labels read from TCP/UDP payloads.

Text protocols are matched with built-in string functions. DNS names and TLS
server names sit behind chained length fields, so those two use Arrow-batched
functions that see only the payloads of their own protocol. They follow the
length fields of a whole batch at once; a payload with a compression pointer
or an international name is read on its own.
"""

from __future__ import annotations

import struct
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DNS_TYPES, HTTP_REQUEST_METHODS

# The Arrow functions travel to the workers by value, so that the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _latin1(payload: Column) -> Column:
    return F.decode(payload, "ISO-8859-1")


def _first_line(payload: Column) -> Column:
    """First line, at most 80 bytes, ASCII characters only, stripped."""
    line = F.substring(F.substring_index(_latin1(F.substring(payload, 1, 80)), "\n", 1), 1, 80)
    ascii_only = F.regexp_replace(line, r"[^\x00-\x7F]", "")
    return F.regexp_replace(ascii_only, r"^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def banner(payload: Column, prefix: str, fallback: str) -> Column:
    """The greeting line of a server whose payload starts with ``prefix``."""
    line = _first_line(payload)
    starts = F.startswith(payload, F.lit(prefix.encode("ascii")))
    return F.when(starts, F.when(line == "", fallback).otherwise(line))


def _header(head: Column, name: str) -> Column:
    """Value of a header field; empty if absent."""
    return F.rtrim(F.regexp_extract(head, rf"(?im)^[ \t]*{name}[ \t]*:[ \t]*([^\r\n]*)", 1))


_GAP = r"\r?\n[ \t]*\r?\n"


def with_http_label(packets: DataFrame, payload: Column, into: str) -> DataFrame:
    """Adds ``HTTP <method> <host><uri>`` or ``HTTP <status> <content type>``.

    The header block must be complete, and so must a body of announced length;
    anything else gives null. Parts that are used more than once are columns
    of their own, so that each pattern is applied once.
    """
    text, gap, head, rest, announced = (F.col(f"_http_{n}") for n in ("text", "gap", "head", "rest", "announced"))
    parts = (
        packets.withColumn("_http_text", _latin1(payload))
        .withColumn("_http_gap", F.regexp_instr(text, F.lit(_GAP)))
        .withColumn("_http_head", F.when(gap > 0, F.left(text, gap - 1)))
        .withColumn("_http_rest", F.when(F.instr(head, "\n") > 0, F.substr(head, F.instr(head, "\n") + 1)).otherwise(
            F.when(head.isNotNull(), "")
        ))
        .withColumn("_http_start", F.substring_index(head, "\n", 1))
        .withColumn("_http_announced", F.nullif(F.trim(_header(rest, "content-length")), F.lit("")))
    )
    start = F.col("_http_start")
    chunked = F.lower(_header(rest, "transfer-encoding")) == "chunked"
    body_bytes = F.length(text) - (gap - 1) - F.length(F.regexp_extract(text, _GAP, 0))
    body_complete = (
        F.when(chunked, F.regexp_like(text, F.lit(r"\r?\n0+[ \t]*(;[^\n]*)?\r?\n")))
        .when(announced.isNull(), True)
        .otherwise(F.coalesce(announced.try_cast("bigint") <= body_bytes, F.lit(False)))
    )
    bad_field = F.regexp_like(rest, F.lit(r"(?m)^(?=[^\r\n])([ \t]*[^\s:]*[ \t]+[^\s:][^:\r\n]*(:|\r?$)|[ \t]*:)"))

    methods = "|".join(HTTP_REQUEST_METHODS)
    is_request = start.rlike(rf"^({methods}) ")
    request_ok = start.rlike(r"^\S+[ \t]+\S+[ \t\r]*$|^\S+[ \t]+\S+[ \t]+HTTP")
    request = F.concat(
        F.lit("HTTP "), F.regexp_extract(start, r"^(\S+)", 1), F.lit(" "), _header(rest, "host"),
        F.regexp_extract(start, r"^\S+[ \t]+(\S+)", 1),
    )
    status = F.regexp_extract(start, r"^HTTP\S*[ \t]+(\d+)(?=[ \t\r]|$)", 1)
    response = F.when(status != "", F.trim(F.concat(F.lit("HTTP "), status, F.lit(" "), _header(rest, "content-type"))))
    label = F.when(head.isNotNull(), F.when(body_complete & ~bad_field, F.when(
        is_request, F.when(request_ok, request)
    ).otherwise(response)))
    return parts.withColumn(into, label).drop(*[c for c in parts.columns if c.startswith("_http_")])


def _dns_question(message: bytes) -> str | None:
    """Label of the first question of a DNS query."""
    if len(message) < 12 or message[2] & 0x80 or not struct.unpack_from(">H", message, 4)[0]:
        return None
    labels, at, end, seen = [], 12, None, set()
    while at < len(message) and message[at]:
        size = message[at]
        if size & 0xC0 == 0xC0:
            if at + 2 > len(message) or at in seen:
                return None
            seen.add(at)
            end = end or at + 2
            at = struct.unpack_from(">H", message, at)[0] & 0x3FFF
        elif size & 0xC0 or at + 1 + size > len(message):
            return None
        else:
            labels.append(message[at + 1 : at + 1 + size].decode("utf-8", "replace"))
            at += 1 + size
    end = end or at + 1
    if at >= len(message) or end + 4 > len(message):
        return None
    kind = struct.unpack_from(">H", message, end)[0]
    return " ".join(filter(None, ["DNS", DNS_TYPES.get(kind, str(kind)), ".".join(labels)]))


def _server_name(record: bytes) -> str:
    """Label of a TLS ClientHello: with the server name if one is readable."""
    plain = "HTTPS/TLS"
    try:
        at = 43
        at += 1 + record[at]
        at += 2 + struct.unpack_from(">H", record, at)[0]
        at += 1 + record[at]
        end = at + 2 + struct.unpack_from(">H", record, at)[0]
        at += 2
        if end > len(record):
            return plain
        while at + 4 <= end:
            kind, size = struct.unpack_from(">HH", record, at)
            at += 4
            if at + size > end:
                return plain
            if kind == 0:
                listed, name_type, name_size = struct.unpack_from(">HBH", record[at : at + size])
                name = record[at + 5 : at + 5 + name_size]
                if listed + 2 > size or name_type != 0 or len(name) < name_size or 5 + name_size > size:
                    return plain
                host = name.decode("ascii", "ignore").encode("ascii").decode("idna")
                return f"{plain} SNI={host}" if host else plain
            at += size
    except (IndexError, struct.error, UnicodeError):
        pass
    return plain


class _Batch:
    """The bytes of a binary array; ``byte`` and ``short`` read at one position of each given row.

    Positions past the end of the batch read as 0; callers check them against ``size``.
    """

    def __init__(self, payload: pa.Array):
        values = payload.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        self.data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
        self.start, self.size = bounds[:-1], np.diff(bounds)

    def byte(self, rows: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        place = self.start[rows] + at
        inside = place < len(self.data)
        found = np.zeros(len(rows), np.int64)
        found[inside] = self.data[place[inside]]
        return found

    def short(self, rows: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        return self.byte(rows, at) * 256 + self.byte(rows, at + 1)


def _cut_texts(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """ASCII texts of the given places."""
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    places = np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[places].tobytes()))


def _has_high_byte(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    high = np.concatenate([[0], np.cumsum(data >= 0x80)])
    return high[start + size] > high[start]


def _placed(count: int, rows: np.ndarray, texts: pa.Array, payload: pa.Array, alone: np.ndarray, read) -> pa.Array:
    """``texts`` at ``rows``, ``read`` applied to the rows ``alone``, null elsewhere."""
    single = pa.array([read(payload[int(r)].as_py()) for r in alone], pa.string())
    order = np.full(count, -1)
    order[rows] = np.arange(len(rows))
    order[alone] = len(rows) + np.arange(len(alone))
    return pa.concat_arrays([texts.cast(pa.string()), single]).take(pa.array(order, mask=order < 0))


def _dns_labels(payload: pa.Array) -> pa.Array:
    batch = _Batch(payload)
    rows = np.flatnonzero(batch.size >= 12)
    rows = rows[(batch.byte(rows, 2) & 0x80 == 0) & (batch.short(rows, 4) > 0)]
    text, at = batch.data.copy(), np.full(len(rows), 12)
    ended, pointed = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    live = np.arange(len(rows))
    while len(live):
        live = live[at[live] < batch.size[rows[live]]]
        here = batch.byte(rows[live], at[live])
        ended[live[here == 0]] = True
        pointed[live[here & 0xC0 == 0xC0]] = True
        following = at[live] + 1 + here
        go = (here > 0) & (here & 0xC0 == 0) & (following <= batch.size[rows[live]])
        live, following = live[go], following[go]
        # Length bytes become the dots between the labels.
        text[batch.start[rows[live]] + at[live]] = ord(".")
        at[live] = following
    whole = ended & (at + 5 <= batch.size[rows])
    start, size = batch.start[rows] + 13, np.maximum(at - 13, 0)
    plain = whole.copy()
    plain[whole] = ~_has_high_byte(batch.data, start[whole], size[whole])
    alone = rows[pointed | (whole & ~plain)]
    names = _cut_texts(text, start[plain], size[plain])
    kinds, which = np.unique(batch.short(rows[plain], at[plain] + 1), return_inverse=True)
    heads = pa.array([f"DNS {DNS_TYPES.get(int(k), k)}" for k in kinds], pa.string()).take(pa.array(which))
    full = pc.binary_join_element_wise(heads, names, " ")
    labels = pc.if_else(pc.equal(pc.binary_length(names), 0), heads, full)
    return _placed(len(payload), rows[plain], labels, payload, alone, _dns_question)


def _tls_labels(payload: pa.Array) -> pa.Array:
    batch = _Batch(payload)
    filled = payload.is_valid().to_numpy(zero_copy_only=False)
    rows, at = np.flatnonzero(filled), np.full(int(filled.sum()), 43)
    # Session id, cipher suites, compression methods: each a length and as many bytes.
    for width, read in ((1, batch.byte), (2, batch.short), (1, batch.byte)):
        inside = at + width <= batch.size[rows]
        rows, at = rows[inside], at[inside]
        at = at + width + read(rows, at)
    inside = at + 2 <= batch.size[rows]
    rows, at = rows[inside], at[inside]
    end, at = at + 2 + batch.short(rows, at), at + 2
    live = np.flatnonzero(end <= batch.size[rows])
    name_size = np.zeros(len(rows), np.int64)
    while len(live):
        live = live[at[live] + 4 <= end[live]]
        kind, size = batch.short(rows[live], at[live]), batch.short(rows[live], at[live] + 2)
        at[live] += 4
        inside = at[live] + size <= end[live]
        listed, of_type = batch.short(rows[live], at[live]), batch.byte(rows[live], at[live] + 2)
        named = batch.short(rows[live], at[live] + 3)
        good = inside & (kind == 0) & (size >= 5) & (listed + 2 <= size) & (of_type == 0) & (5 + named <= size)
        name_size[live[good]] = named[good]
        go = inside & (kind != 0)
        at[live[go]] += size[go]
        live = live[go]
    found = name_size > 0
    rows, start, size = rows[found], batch.start[rows[found]] + at[found] + 5, name_size[found]
    high = _has_high_byte(batch.data, start, size)
    names = _cut_texts(batch.data, start[~high], size[~high])
    coded = pc.match_substring(names, "xn--", ignore_case=True).to_numpy(zero_copy_only=False)
    plain = rows[~high][~coded]
    alone = np.setdiff1d(rows, plain)
    labels = pc.binary_join_element_wise(pa.scalar("HTTPS/TLS SNI="), names.filter(pa.array(~coded)), "")
    named = _placed(len(payload), plain, labels, payload, alone, _server_name)
    return pc.if_else(payload.is_valid(), pc.fill_null(named, "HTTPS/TLS"), pa.scalar(None, pa.string()))


@F.arrow_udf(T.StringType())
def _dns_udf(payload: pa.Array) -> pa.Array:
    return _dns_labels(payload)


@F.arrow_udf(T.StringType())
def _tls_udf(payload: pa.Array) -> pa.Array:
    return _tls_labels(payload)


def dns_label(payload: Column) -> Column:
    return _dns_udf(payload)


def tls_label(payload: Column) -> Column:
    return _tls_udf(payload)
