from .address import cidr_address, cidr_prefix_len, ip_bits, ip_family
from .display import (
    artifact_name,
    base_name,
    format_build_date,
    format_hit_time,
    format_size,
    percent,
    rfc3339,
    sha256_hex,
    source_label,
)
from .globs import glob_literals, glob_to_regex, suffix_key
from .payload import build_epoch, flatten_payload, pick_description, variant_text

__all__ = [
    "artifact_name",
    "base_name",
    "build_epoch",
    "cidr_address",
    "cidr_prefix_len",
    "flatten_payload",
    "format_build_date",
    "format_hit_time",
    "format_size",
    "glob_literals",
    "glob_to_regex",
    "ip_bits",
    "ip_family",
    "percent",
    "pick_description",
    "rfc3339",
    "sha256_hex",
    "source_label",
    "suffix_key",
    "variant_text",
]
