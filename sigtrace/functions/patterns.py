"""Fixed text patterns of the candidate extractor and the indicator parser.

A token pattern cuts whole runs of characters out of a line, which a second
pattern then accepts or rejects; so a run that is too long or has a part too many
is never taken in pieces.  Bounds are in the second pattern only.  Where few positions can start a token the first character
is asked for before the look-behind.  Word boundaries are spelled out, since ``\\b`` next to
non-ASCII letters differs between Java versions.  Runs start where the look-behind
says so and are single classes repeated possessively: a line of any length is
scanned in linear time and without deep recursion.
"""

# -- fixed values: text patterns ---------------------------------------------
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_ADDRESS = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
IPV4_TOKEN = (
    r"[0-9](?<!(?:[0-9A-Za-z_]|[0-9]\.)[0-9])[0-9]{0,3}+(?:\.[0-9]{1,4}+){3,126}+(?![0-9A-Za-z_])"
)

GROUP = r"[0-9A-Fa-f]{1,4}"
DOTTED = rf"{OCTET}(?:\.{OCTET}){{3}}"
IPV6_FORMS = (
    f"(?:{GROUP}:){{7}}{GROUP}",
    f"(?:{GROUP}:){{1,7}}:",
    f":(?::{GROUP}){{1,7}}",
    "::",
    *(f"(?:{GROUP}:){{1,{7 - n}}}(?::{GROUP}){{1,{n}}}" for n in range(1, 7)),
    f"(?:{GROUP}:){{6}}{DOTTED}",
    f"(?:{GROUP}:){{1,5}}:{DOTTED}",
    f"::(?:{GROUP}:){{0,5}}{DOTTED}",
    *(f"(?:{GROUP}:){{1,{5 - n}}}(?::{GROUP}){{1,{n}}}:{DOTTED}" for n in range(1, 5)),
)
IPV6_ADDRESS = "^(?:" + "|".join(IPV6_FORMS) + ")$"
IPV6_DOTTED_TAIL = f":({DOTTED})$"
IPV6_TOKEN = r"(?<![0-9A-Za-z_:.])[0-9A-Za-z_.]*+:[0-9A-Za-z_:.]*+"
IPV6_GROUP = r"^[0-9A-Fa-f.]*$"

LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
HOST_LABEL = r"[A-Za-z0-9_](?:[A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?"
DOMAIN_TOKEN = r"(?<![A-Za-z0-9._-])[A-Za-z0-9_-]*+\.[A-Za-z0-9._-]++"
DOMAIN_NAME = rf"^(?:{HOST_LABEL}\.){{1,126}}{LABEL}$"

EMAIL_TOKEN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9._-]++"
EMAIL_ADDRESS = (
    rf"^[^@]{{1,64}}@(?:{LABEL}\.){{1,126}}(?:[A-Za-z]{{2,63}}|[Xx][Nn]--[A-Za-z0-9-]{{0,58}}[A-Za-z0-9])$"
)

LONG_TOKEN = r"(?<![0-9A-Za-z_])[0-9A-Za-z_]{26}[0-9A-Za-z_]*+"
HEX_HASH = r"^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$"
BITCOIN = r"^(?:[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71})$"
ETHEREUM = r"^0x[0-9A-Fa-f]{40}$"
LONG_FORMS = "|".join((HEX_HASH, ETHEREUM, BITCOIN))

# Every token, and every character that the token patterns look at beside one, is of one class, so that a token lies
# within one run of the class.
RUN = r"[0-9A-Za-z_.:%+@-]++"
LONG_LEAST = 26

# What a run must contain for a token pattern to be worth trying; MARK_HINT stands for the four that are not long.
IPV4_HINT = r"[0-9]\.[0-9]"
DOMAIN_HINT = r"\.[0-9A-Za-z._-]"
MARK_HINT = r"[.:@][0-9A-Za-z_:.-]"
# A long token that is no hexadecimal number of letters only has a digit.
DIGIT_HINT = r"[0-9]"
HEX_HINT = r"[A-Fa-f]{32}"

RFC3339 = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}"
    r"(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})$"
)

# -- fixed values: candidate type names --------------------------------------
IPV4_TYPE = "IPv4"
IPV6_TYPE = "IPv6"
DOMAIN_TYPE = "Domain"
EMAIL_TYPE = "Email"
MD5_TYPE = "MD5"
SHA1_TYPE = "SHA1"
SHA256_TYPE = "SHA256"
BITCOIN_TYPE = "Bitcoin"
ETHEREUM_TYPE = "Ethereum"
TYPES = (
    IPV4_TYPE,
    IPV6_TYPE,
    DOMAIN_TYPE,
    EMAIL_TYPE,
    MD5_TYPE,
    SHA1_TYPE,
    SHA256_TYPE,
    BITCOIN_TYPE,
    ETHEREUM_TYPE,
)

# -- fixed values: feed modes ------------------------------------------------
CASE_SENSITIVE = "CaseSensitive"
CASE_INSENSITIVE = "CaseInsensitive"
