from snapfolio.functions.keys import normalize_key, strip_key
from snapfolio.functions.payload import (
    decode_payload,
    encode_payload,
    has_content,
    is_falsy,
    is_valid_json,
    member_text,
    payload_kind,
)
from snapfolio.functions.times import utc_time

__all__ = [
    "decode_payload",
    "encode_payload",
    "has_content",
    "is_falsy",
    "is_valid_json",
    "member_text",
    "normalize_key",
    "payload_kind",
    "strip_key",
    "utc_time",
]
