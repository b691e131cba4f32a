"""IP addresses and networks as fixed-width keys, and their classes."""

from __future__ import annotations

from ipaddress import ip_address, ip_network

CLASSES = ("is_private", "is_global", "is_loopback", "is_link_local", "is_multicast", "is_reserved")


def key_of(ip: str) -> str | None:
    """Family digit and 32 hexadecimal digits, so that text order is address order; None if invalid."""
    try:
        a = ip_address(ip)
    except ValueError:
        return None
    return f"{a.version}{int(a):032x}"


def range_of(network: str) -> tuple[str, str, int]:
    """Keys of the first and last address of a network, and its prefix length."""
    n = ip_network(network)
    return f"{n.version}{int(n.network_address):032x}", f"{n.version}{int(n.broadcast_address):032x}", n.prefixlen


def classes_of(ip: str | None) -> tuple[int | None, bool | None, bool | None, bool | None, bool | None, bool | None, bool | None]:
    """Version and the six class flags; None for what is no address."""
    try:
        a = ip_address(ip) if ip is not None else None
    except ValueError:
        a = None
    if a is None:
        return (None,) * (1 + len(CLASSES))
    return (a.version, *(bool(getattr(a, c)) for c in CLASSES))
