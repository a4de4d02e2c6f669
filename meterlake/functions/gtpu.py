"""GTP-U header decoding as projections; the extension chain is a bounded fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.bytes import bits, field, part, size, uint

# Message types, the extension that carries the QFI, statuses.
ECHO_REQUEST, ECHO_RESPONSE, ERROR_INDICATION, SUPPORTED_EXTENSIONS, END_MARKER, GPDU = 1, 2, 26, 31, 254, 255
PDU_SESSION = 0x85
STATUSES = ("ok", "truncated", "bad-version", "not-gtpu", "bad-length", "bad-ext-header", "ext-chain-too-long")
MAX_LINKS = 16


def _chain(b: Column, length: Column, first: Column) -> Column:
    """struct(off, next, links, status, has_qfi, pdu_type, qfi, rqi) behind the chain in ``b`` of ``length`` bytes."""

    def state(s, **new):
        kinds = {"off": "long", "next": "long", "links": "int", "status": "string", "has_qfi": "boolean", "pdu_type": "int", "qfi": "int", "rqi": "boolean"}
        return F.struct(*((new[k] if k in new else s[k]).cast(t).alias(k) for k, t in kinds.items()))

    def failed(s, status):
        return state(s, links=s["links"] + 1, status=F.lit(status))

    def step(s, _):
        off = s["off"]
        units = uint(b, off, 1)
        behind = off + units * 4
        here = (s["next"] == PDU_SESSION) & (units >= 1)
        kind = F.shiftright(uint(b, off + 1, 1), 4)
        octet = uint(b, off + 2, 1)
        moved = state(
            s, off=behind, next=uint(b, behind - 1, 1), links=s["links"] + 1, has_qfi=s["has_qfi"] | here, pdu_type=F.when(here, kind).otherwise(s["pdu_type"]),
            qfi=F.when(here, bits(octet, 0x3F)).otherwise(s["qfi"]), rqi=F.when(here, (kind == 0) & (bits(octet, 0x40) != 0)).otherwise(s["rqi"]),
        )
        return (
            F.when((s["next"] == 0) | (s["status"] != "ok"), s)
            .when(s["links"] + 1 > MAX_LINKS, failed(s, "ext-chain-too-long"))
            .when(off >= length, failed(s, "truncated"))
            .when(units == 0, failed(s, "bad-ext-header"))
            .when(behind > length, failed(s, "truncated"))
            .otherwise(moved)
        )

    none = F.lit(None)
    start = state({}, off=F.lit(0), next=first, links=F.lit(0), status=F.lit("ok"), has_qfi=F.lit(False), pdu_type=none, qfi=none, rqi=F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_LINKS + 1)), start, step)


def gtpu(df: DataFrame, pdu: str, prefix: str = "gtpu_") -> DataFrame:
    """Adds status, msg_type, declared_len, teid, seq, npdu, has_seq, has_npdu, has_ext, ext_count, has_qfi, pdu_type, qfi, rqi, header_len, payload.

    All NULL where ``pdu`` is NULL; all but the status NULL where it isn't "ok".
    """
    p = lambda name: F.col(prefix + name)
    b = F.col(pdu)
    df = df.withColumns({prefix + "n": size(b), prefix + "w": F.when(size(b) >= 8, uint(b, 0, 4))})
    df = df.withColumns({prefix + "flags": field(p("w"), 4, 0), prefix + "declared": field(p("w"), 4, 2, 2)})
    extra = bits(p("flags"), 7) != 0
    early = (
        F.when(b.isNull(), None).when(p("n") < 8, "truncated").when(F.shiftright(p("flags"), 5) != 1, "bad-version").when(bits(p("flags"), 0x10) == 0, "not-gtpu")
        .when(p("n") - 8 < p("declared"), "truncated").when(extra & (p("declared") < 4), "bad-length").otherwise("ok")
    )
    df = df.withColumns({prefix + "early": early, prefix + "opt": F.when(extra, 4).otherwise(0), prefix + "o": F.when(extra & (early == "ok"), uint(b, 8, 4))})
    follows = field(p("o"), 4, 3)
    chained = (p("early") == "ok") & (bits(p("flags"), 4) != 0) & (follows != 0)
    df = df.withColumns({prefix + "chain": F.when(chained, _chain(part(b, 12, p("declared") - 4), p("declared") - 4, follows))})
    chain = p("chain")
    df = df.withColumns({prefix + "status": F.coalesce(chain["status"], p("early"))})
    ok = p("status") == "ok"
    head = 8 + p("opt") + F.coalesce(chain["off"], F.lit(0))
    seq, npdu = bits(p("flags"), 2) != 0, bits(p("flags"), 1) != 0
    df = df.withColumns({prefix + "header_len": F.when(ok, head)})
    return df.withColumns({
        prefix + "msg_type": F.when(ok, field(p("w"), 4, 1)), prefix + "declared_len": F.when(ok, p("declared")), prefix + "teid": F.when(ok, uint(b, 4, 4)),
        prefix + "seq": F.when(ok & seq, field(p("o"), 4, 0, 2)), prefix + "npdu": F.when(ok & npdu, field(p("o"), 4, 2)), prefix + "has_seq": F.when(ok, seq), prefix + "has_npdu": F.when(ok, npdu),
        prefix + "has_ext": F.when(ok, chain.isNotNull()), prefix + "ext_count": F.when(ok, F.coalesce(chain["links"], F.lit(0))),
        prefix + "has_qfi": F.when(ok, F.coalesce(chain["has_qfi"], F.lit(False))), prefix + "pdu_type": F.when(ok, chain["pdu_type"]), prefix + "qfi": F.when(ok, chain["qfi"]),
        prefix + "rqi": F.when(ok, F.coalesce(chain["rqi"], F.lit(False))), prefix + "payload": F.when(ok, part(b, p("header_len"), 8 + p("declared") - p("header_len"))),
    }).drop(*(prefix + x for x in ("n", "w", "o", "flags", "declared", "early", "opt", "chain")))
