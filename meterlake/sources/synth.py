"""Frames built byte by byte, and a traffic generator that knows what it made. For tests and trials, on the driver."""

from __future__ import annotations

import random
import struct
from dataclasses import dataclass, field

from meterlake.functions import diameter as d


def checksum(data: bytes) -> int:
    """The internet checksum: ones' complement of the ones' complement sum of 16-bit words."""
    data += b"\0" * (len(data) % 2)
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def ipv4(payload: bytes, proto: int = 17, src: str = "10.0.0.1", dst: str = "10.0.0.2", field_: int = 0, options: bytes = b"", total: int | None = None) -> bytes:
    head = 20 + len(options)
    address = lambda x: bytes(map(int, x.split(".")))
    own = struct.pack(">BBHHHBBH", 0x40 | head // 4, 0, head + len(payload) if total is None else total, 0, field_, 64, proto, 0) + address(src) + address(dst) + options
    return own[:10] + checksum(own).to_bytes(2) + own[12:] + payload


def ipv6(payload: bytes, proto: int = 17, src: bytes = b"\x20" + b"\0" * 15, dst: bytes = b"\x20" + b"\0" * 14 + b"\x01") -> bytes:
    return struct.pack(">IHBB", 6 << 28, len(payload), proto, 64) + src + dst + payload


def udp(payload: bytes, src: int = 2152, dst: int = 2152) -> bytes:
    return struct.pack(">HHHH", src, dst, 8 + len(payload), 0) + payload


def tcp(payload: bytes, src: int = 40000, dst: int = 3868, options: bytes = b"") -> bytes:
    return struct.pack(">HHIIBBHHH", src, dst, 0, 0, (20 + len(options)) // 4 << 4, 0x18, 0, 0, 0) + options + payload


def sctp(payload: bytes, src: int = 40000, dst: int = 3868) -> bytes:
    return struct.pack(">HHII", src, dst, 0, 0) + payload


def ethernet(packet: bytes, ethertype: int = 0x0800, tags: tuple[int, ...] = ()) -> bytes:
    kinds = [*(0x8100 for _ in tags), ethertype]
    return b"\x02" * 12 + kinds[0].to_bytes(2) + b"".join(struct.pack(">HH", t, k) for t, k in zip(tags, kinds[1:], strict=True)) + packet


def gtpu(payload: bytes, teid: int, msg_type: int = 255, qfi: int | None = None, uplink: bool = True, seq: int | None = None, links: tuple[tuple[int, bytes], ...] = ()) -> bytes:
    """links: (type, content) of further extension headers; contents fill 4n - 2 bytes."""
    chain = ([(0x85, bytes([0x10 if uplink else 0, qfi]))] if qfi is not None else []) + list(links)
    flags, extra = 0x30, b""
    if chain or seq is not None:
        flags |= (4 if chain else 0) | (2 if seq is not None else 0)
        extra = struct.pack(">HBB", seq or 0, 0, chain[0][0] if chain else 0)
        for i, (_, content) in enumerate(chain):
            extra += bytes([(len(content) + 2) // 4]) + content + bytes([chain[i + 1][0] if i + 1 < len(chain) else 0])
    return struct.pack(">BBHI", flags, msg_type, len(extra) + len(payload), teid) + extra + payload


def tunnel_frame(teid: int, payload: int, qfi: int | None = None, uplink: bool = True, msg_type: int = 255, src: str = "10.45.0.1", dst: str = "93.184.216.34", port: int = 20000) -> bytes:
    inner = ipv4(udp(b"Z" * payload, port, 443), 17, src, dst) if msg_type == 255 else b""
    return ethernet(ipv4(udp(gtpu(inner, teid, msg_type, qfi, uplink))))


def avp(code: int, value: bytes, vendor: int | None = None) -> bytes:
    head = 8 if vendor is None else 12
    n = head + len(value)
    return code.to_bytes(4) + bytes([0x40 if vendor is None else 0xC0]) + n.to_bytes(3) + (b"" if vendor is None else vendor.to_bytes(4)) + value + b"\0" * (-n % 4)


def message(avps: bytes, request: bool = True, command: int = d.CREDIT_CONTROL, application: int = 4) -> bytes:
    n = d.HEADER + len(avps)
    return b"\x01" + n.to_bytes(3) + bytes([0x80 if request else 0]) + command.to_bytes(3) + application.to_bytes(4) + b"\0" * 8 + avps


def ccr(imsi: int | str, services: list[dict], request: bool = True, kind: int = 2, number: int = 0) -> bytes:
    """services: rating_group and any of input, output, total, granted."""
    octets = {"input": d.INPUT_OCTETS, "output": d.OUTPUT_OCTETS, "total": d.TOTAL_OCTETS}
    body = avp(d.SESSION_ID, b"session;1") + avp(d.ORIGIN_HOST, b"pcef.example") + avp(d.CC_REQUEST_TYPE, kind.to_bytes(4)) + avp(d.CC_REQUEST_NUMBER, number.to_bytes(4))
    body += avp(d.SUBSCRIPTION_ID, avp(d.SUBSCRIPTION_ID_TYPE, d.IMSI.to_bytes(4)) + avp(d.SUBSCRIPTION_ID_DATA, str(imsi).encode()))
    if not request:
        body += avp(d.RESULT_CODE, (2001).to_bytes(4))
    for s in services:
        own = avp(d.RATING_GROUP, s["rating_group"].to_bytes(4))
        if used := b"".join(avp(octets[k], s[k].to_bytes(8)) for k in octets if k in s):
            own += avp(d.USED_UNIT, used)
        if "granted" in s:
            own += avp(d.GRANTED_UNIT, avp(d.TOTAL_OCTETS, s["granted"].to_bytes(8)))
        body += avp(d.MSCC, own)
    return message(body, request)


@dataclass
class Traffic:
    packets: list[tuple[int, int, bytes]] = field(default_factory=list)  # (ts_ns, orig_len, data)
    sessions: list[tuple] = field(default_factory=list)
    expected: dict[int, dict[str, int]] = field(default_factory=dict)  # by IMSI


def generate(packets: int = 10_000, subscribers: int = 50, seed: int = 1, noise: int = 100, uplink: float = 0.35, sizes: tuple[int, ...] = (64, 128, 512, 1400), start_ns: int = 1_700_000_000_000_000_000) -> Traffic:
    """Tunnel packets of a session table, echoes, noise and a charging exchange a subscriber, in an order shuffled by seed."""
    rng, out, frames = random.Random(seed), Traffic(), []
    own = []
    for i in range(subscribers):
        imsi, ul = 310150000000001 + i, 0x10000 + 2 * i
        out.sessions.append((i, imsi, ul, ul + 1, rng.choice((10, 20, 30)), "", "internet"))
        out.expected[imsi] = dict.fromkeys(("ul_bytes", "dl_bytes", "ul_packets", "dl_packets"), 0)
        own.append((imsi, ul, rng.choice((None, 1, 5, 9))))
    for _ in range(packets):
        imsi, ul, qfi = rng.choice(own)
        up, n = rng.random() < uplink, rng.choice(sizes)
        frames.append(tunnel_frame(ul if up else ul + 1, n, qfi, up))
        side = "ul" if up else "dl"
        out.expected[imsi][f"{side}_bytes"] += n + 28
        out.expected[imsi][f"{side}_packets"] += 1
    frames += [ethernet(ipv4(udp(b"noise", 53, 53))) for _ in range(noise)] + [tunnel_frame(0, 0, msg_type=1)] * 2
    rng.shuffle(frames)
    for imsi, _, _ in own:
        e = out.expected[imsi]
        frames += [ethernet(ipv4(tcp(ccr(imsi, [{"rating_group": 10, "input": e["ul_bytes"], "output": e["dl_bytes"]}])), 6)), ethernet(ipv4(tcp(ccr(imsi, [{"rating_group": 10, "granted": 1 << 20}], False), 3868, 40000), 6))]
    out.packets = [(start_ns + 1000 * i, len(x), x) for i, x in enumerate(frames)]
    return out
