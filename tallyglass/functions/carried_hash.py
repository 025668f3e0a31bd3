"""SHA-256 whose inner state goes on in another task; hashlib keeps its state to itself."""

from __future__ import annotations

import ctypes
import hashlib
from functools import cache


class _State(ctypes.Structure):
    """SHA256_CTX of <openssl/sha.h>, the public struct of OpenSSL's digest calls."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("block", ctypes.c_uint32 * 16), ("filled", ctypes.c_uint), ("size", ctypes.c_uint)]


@cache
def _calls() -> tuple | None:
    """Init, update and final of the OpenSSL that hashlib itself uses; None where Python is built without it."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        first, more, final = library.SHA256_Init, library.SHA256_Update, library.SHA256_Final
    except (ImportError, OSError, AttributeError):
        return None
    first.argtypes = [ctypes.POINTER(_State)]
    more.argtypes = [ctypes.POINTER(_State), ctypes.c_char_p, ctypes.c_size_t]
    final.argtypes = [ctypes.c_char_p, ctypes.POINTER(_State)]
    return first, more, final


class CarriedSha256:
    """SHA-256 that starts from the state another one gave."""

    def __init__(self, state: bytes | None = None):
        if _calls() is None:
            raise RuntimeError("Python's hashlib is built without OpenSSL: no state can be carried")
        self._state = _State.from_buffer_copy(state) if state else _State()
        if not state:
            _calls()[0](self._state)

    def update(self, data: bytes) -> None:
        _calls()[1](self._state, data, len(data))

    def state(self) -> bytes:
        return bytes(self._state)

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), _State.from_buffer_copy(self._state)
        _calls()[2](out, last)
        return out.raw.hex()


@cache
def can_carry() -> bool:
    """Whether a state can be carried here, tried on a text cut inside a block."""
    if _calls() is None:
        return False
    text = bytes(range(256)) * 3
    first = CarriedSha256()
    first.update(text[:333])
    second = CarriedSha256(first.state())
    second.update(text[333:])
    return second.hexdigest() == hashlib.sha256(text).hexdigest()
