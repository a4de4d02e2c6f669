"""Link layer, Ethernet and IP decoding as projections.

Each function takes a DataFrame and the name of a BINARY column and adds columns under a prefix. Intermediate values
are columns of their own, so each is computed once and all of it stays within generated code; only the IPv6 extension
walk is a fold, and only version 6 packets enter it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.bytes import bits, field, let, part, size, uint

# IP protocol numbers, EtherTypes, link types.
TCP, UDP, SCTP = 6, 17, 132
HOP_BY_HOP, ROUTING, FRAGMENT, AUTHENTICATION, DESTINATION = 0, 43, 44, 51, 60
VLAN_TAGS = (0x8100, 0x88A8)
LINK_ETHERNET, LINK_RAW, LINK_SLL = 1, (101, 228, 229), 113
MAX_IPV6_HEADERS = 8


def strip_link(df: DataFrame, data: str = "data", link_type: str = "link_type") -> DataFrame:
    """Adds ``eth`` (Ethernet frames) or ``l3`` (packets without it); both NULL on a link type that isn't read."""
    raw = F.col(link_type).isin(*LINK_RAW)
    cooked = (F.col(link_type) == LINK_SLL) & (size(F.col(data)) > 16)
    return df.withColumns({
        "eth": F.when(F.col(link_type) == LINK_ETHERNET, F.col(data)),
        "l3": F.when(raw, F.col(data)).when(cooked, part(F.col(data), 16, size(F.col(data)) - 16)),
    })


def ethernet(df: DataFrame, frame: str, prefix: str = "eth_") -> DataFrame:
    """Adds valid, vlan_tags, ethertype and payload. At most two tags are peeled; the EtherType isn't judged."""
    b, n = F.col(frame), size(F.col(frame))
    df = df.withColumns({f"{prefix}t0": F.when(n >= 14, uint(b, 12, 2))})
    one = F.col(f"{prefix}t0").isin(*VLAN_TAGS)
    df = df.withColumns({f"{prefix}t1": F.when(one & (n >= 18), uint(b, 16, 2))})
    two = one & F.coalesce(F.col(f"{prefix}t1").isin(*VLAN_TAGS), F.lit(False))
    tags = F.when(two, 2).when(one, 1).otherwise(0)
    valid = F.coalesce((n >= 14) & (n >= 14 + 4 * tags), F.lit(False))
    df = df.withColumns({f"{prefix}vlan_tags": tags, f"{prefix}valid": valid})
    at = 14 + 4 * F.col(f"{prefix}vlan_tags")
    ok = F.col(f"{prefix}valid")
    kind = F.when(F.col(f"{prefix}vlan_tags") == 0, F.col(f"{prefix}t0")).otherwise(uint(b, at - 2, 2))
    return df.withColumns({f"{prefix}ethertype": F.when(ok, kind), f"{prefix}payload": F.when(ok, part(b, at, n - at))}).drop(f"{prefix}t0", f"{prefix}t1")


def _walk(b: Column, end: Column) -> Column:
    """The IPv6 extension walk: struct(off, next, frag, stop); stop 1: at the payload, 2: overrun, 3: a later fragment."""

    def state(off, nxt, frag, stop):
        return F.struct(off.cast("long").alias("off"), nxt.cast("long").alias("next"), frag.alias("frag"), stop.cast("int").alias("stop"))

    def step(s, _):
        off, nxt = s["off"], s["next"]
        extension = nxt.isin(HOP_BY_HOP, ROUTING, DESTINATION, AUTHENTICATION, FRAGMENT)
        field = uint(b, off + 2, 2)
        follows = uint(b, off, 1)
        units = uint(b, off + 1, 1)
        length = F.when(nxt == AUTHENTICATION, (units + 2) * 4).otherwise((units + 1) * 8)
        later = bits(field, 0xFFF8) != 0
        return (
            F.when(s["stop"] != 0, s)
            .when(~extension, state(off, nxt, s["frag"], F.lit(1)))
            .when(off + 8 > end, state(off, nxt, s["frag"], F.lit(2)))
            .when(nxt == FRAGMENT, state(off + 8, follows, bits(field, 0xFFF9) != 0, F.when(later, 3).otherwise(0)))
            .when(off + length > end, state(off, nxt, s["frag"], F.lit(2)))
            .otherwise(state(off + length, follows, s["frag"], F.lit(0)))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_IPV6_HEADERS)), state(F.lit(40), uint(b, 6, 1), F.lit(False), F.lit(0)), step)


def ip(df: DataFrame, packet: str, prefix: str) -> DataFrame:
    """Adds valid, version, proto, fragmented, src, dst, header_len, total_len, src_port, dst_port, ports_valid, payload.

    total_len is what the header claims; the transport area is cut at what was captured.
    """
    p = lambda name: F.col(prefix + name)
    b = F.col(packet)
    df = df.withColumns({prefix + "n": size(b), prefix + "w": F.when(size(b) >= 20, uint(b, 0, 7)), prefix + "x": F.when(size(b) >= 20, uint(b, 7, 3))})
    n, word = p("n"), lambda offset, width=1: field(p("w"), 7, offset, width)
    version, ihl, total = F.shiftright(word(0), 4), bits(word(0), 15) * 4, word(2, 2)
    four = F.coalesce((n >= 20) & (version == 4) & (ihl >= 20) & (ihl <= n) & (total >= ihl), F.lit(False))
    six = F.coalesce((n >= 40) & (version == 6), F.lit(False))
    df = df.withColumns({prefix + "version": F.when(four, 4).when(six, 6)})
    is4, is6 = p("version") == 4, p("version") == 6
    df = df.withColumns({
        prefix + "valid": p("version").isNotNull(),
        prefix + "total_len": F.when(is4, total).when(is6, word(4, 2) + 40),
        prefix + "field": F.when(is4, F.shiftleft(word(6), 8).bitwiseOR(field(p("x"), 3, 0))),
    })
    end = F.least(p("total_len"), n)
    df = df.withColumns({prefix + "end": end, prefix + "walk": F.when(is6, _walk(b, F.least(word(4, 2) + 40, n)))})
    walk = p("walk")
    reached = walk["stop"].isin(0, 1)
    header = F.when(is4, ihl).when(is6, F.when(walk["stop"] == 2, F.lit(40)).otherwise(walk["off"]))
    df = df.withColumns({
        prefix + "proto": F.when(is4, field(p("x"), 3, 2)).when(is6, walk["next"]),
        prefix + "fragmented": F.when(is4, bits(p("field"), 0x3FFF) != 0).when(is6, walk["frag"]),
        prefix + "src": F.when(is4, part(b, 12, 4)).when(is6, part(b, 8, 16)),
        prefix + "dst": F.when(is4, part(b, 16, 4)).when(is6, part(b, 24, 16)),
        prefix + "header_len": header,
        prefix + "has_l4": F.when(is4, bits(p("field"), 0x1FFF) == 0).when(is6, reached & (walk["off"] <= p("end"))),
    })
    room = p("end") - p("header_len")
    least = F.when(p("proto") == UDP, 8).when(p("proto") == TCP, 20).when(p("proto") == SCTP, 12)
    ports = F.coalesce(p("has_l4") & (room >= least), F.lit(False))
    at = p("header_len")
    df = df.withColumns({prefix + "ports_valid": ports, prefix + "ports": F.when(ports, uint(b, at, 4))})
    ports = p("ports_valid")
    df = df.withColumns({
        prefix + "src_port": field(p("ports"), 4, 0, 2),
        prefix + "dst_port": field(p("ports"), 4, 2, 2),
        prefix + "l4": F.when(ports, F.when(p("proto") == TCP, F.shiftright(uint(b, at + 12, 1), 4) * 4).otherwise(least)),
    })
    whole = ports & (p("l4") >= least) & (p("l4") <= room)
    payload = F.when(whole, part(b, at + p("l4"), room - p("l4")))
    df = df.withColumns({prefix + "payload": payload})
    return df.drop(*(prefix + x for x in ("n", "w", "x", "field", "end", "walk", "ports", "has_l4", "l4")))


def format_ip(address: Column) -> Column:
    """Dotted for 4 bytes; eight groups of hexadecimal without leading zeros, never shortened, for 16; else "-"."""
    four = F.concat_ws(".", *(uint(address, i, 1).cast("string") for i in range(4)))
    six = F.concat_ws(":", *(F.lower(F.conv(F.hex(part(address, 2 * i, 2)), 16, 16)) for i in range(8)))
    return F.when(F.octet_length(address) == 4, four).when(F.octet_length(address) == 16, six).otherwise("-")


def flow_key(src: Column, dst: Column, src_port: Column, dst_port: Column, proto: Column, version: Column) -> Column:
    """FNV-1a over the tuple's bytes, as the bit pattern of a signed long.

    The start value is a fixed value that keys have to agree on; it isn't the usual basis of FNV-1a.
    64-bit products would overflow, so the hash is held as two 32-bit limbs; the prime is 2^40 + 435.
    """
    port = lambda c: F.unhex(F.lpad(F.hex(F.coalesce(c, F.lit(0)).cast("long")), 4, "0"))
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    start = 1469598103934665603  # Fixed value

    def limbs(hi, lo):
        return F.struct(hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))

    def mix(data):
        def step(h, i):
            return let(h["lo"].bitwiseXOR(uint(data, i, 1)), lambda x: limbs(bits(h["hi"] * 435 + F.shiftright(x * 435, 32) + F.shiftleft(x, 8), 0xFFFFFFFF), bits(x * 435, 0xFFFFFFFF)))

        return F.aggregate(F.sequence(F.lit(0), F.octet_length(data) - 1), limbs(F.lit(start >> 32), F.lit(start & 0xFFFFFFFF)), step, lambda h: F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"]))

    return let(F.concat(src, dst, port(src_port), port(dst_port), byte(proto), byte(version)), mix)
