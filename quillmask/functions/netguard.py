"""A guard against outbound connections of this Python process; the JVM's sockets are out of reach.

``connect`` and ``connect_ex`` of sockets raise ``Blocked`` for any address that is not loopback.
"""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Iterator
from contextlib import contextmanager

_original: dict[str, object] = {}


class Blocked(OSError):
    """An outbound connection was tried."""


def is_local(address: object) -> bool:
    """Unix paths, ``localhost``, the unspecified address and loopback in IPv4, IPv6 or mapped form."""
    if not isinstance(address, tuple):
        return True
    host = str(address[0]).partition("%")[0].lower()
    if host in ("", "localhost"):
        return True
    try:
        parsed = ipaddress.ip_address(host)
    except ValueError:
        return False
    parsed = getattr(parsed, "ipv4_mapped", None) or parsed
    return parsed.is_loopback or parsed.is_unspecified


def is_installed() -> bool:
    return bool(_original)


def install() -> None:
    if _original:
        return
    for name in ("connect", "connect_ex"):
        plain = getattr(socket.socket, name)
        _original[name] = plain

        def guarded(self: socket.socket, address: object, _plain=plain):
            if not is_local(address):
                raise Blocked(f"connection to {address!r} is blocked while redacting")
            return _plain(self, address)

        setattr(socket.socket, name, guarded)


def uninstall() -> None:
    for name, plain in _original.items():
        setattr(socket.socket, name, plain)
    _original.clear()


@contextmanager
def offline(enabled: bool = True) -> Iterator[None]:
    """Guarded inside, as before outside."""
    mine = enabled and not is_installed()
    if mine:
        install()
    try:
        yield
    finally:
        if mine:
            uninstall()
