"""Client-address truncation: IPv4 keeps its top 8 bits, IPv6 its top 32."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblake.schema import NO_VALUE

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = f"{_OCTET}(?:[.]{_OCTET}){{3}}"
_GROUP = "[0-9a-f]{1,4}"


def _v6_pattern() -> str:
    """Eight groups, or at most seven around one ``::``; a dotted quad may stand for the last two."""
    left = f"(?:{_GROUP}:)"
    right = f"(?::{_GROUP})"
    forms = [f"{left}{{7}}{_GROUP}", f"{left}{{1,7}}:", f":{right}{{1,7}}", "::"]
    forms += [f"{left}{{1,{7 - n}}}{right}{{{n}}}" for n in range(1, 7)]
    forms += [f"{left}{{6}}{_QUAD}", f":{right}{{0,5}}:{_QUAD}"]
    forms += [f"{left}{{1,{5 - n}}}{right}{{{n}}}:{_QUAD}" for n in range(0, 5)]
    return f"^(?i:{'|'.join(forms)})(?:%[^%/]+)?\\z"


_V4 = f"^{_QUAD}\\z"
_V6 = _v6_pattern()

# '::' before seven groups (a dotted quad is two) stands for a single zero group.
_ONE_GROUP_GAP = "^::(?=(?:[^:.%]+:){6}[^:.%]+(?:%|\\z)|(?:[^:.%]+:){5}[^:.%]+[.])"
_FIRST_TWO = "^0*([0-9a-f]*):0*([0-9a-f]*):.*\\z"


def _mask_v6(address: Column) -> Column:
    """Keep the first two groups of a valid address; each step feeds the next one only."""
    text = F.regexp_replace(F.lower(address), _ONE_GROUP_GAP, "0:")
    text = F.regexp_replace(text, _FIRST_TWO, "$1:$2::")
    text = F.replace(text, F.lit(":::"), F.lit("::"))
    return F.regexp_replace(text, "^:(?=[^:])", "0:")


def mask_address(address: Column) -> Column:
    """The truncated address, or null if ``address`` is no IP address."""
    return F.when(address.rlike(_V4), F.concat(F.substring_index(address, ".", 1), F.lit(".0.0.0"))).when(
        address.rlike(_V6), _mask_v6(address)
    )


def mask_field(address: Column) -> Column:
    """As :func:`mask_address`, with the no-value mark left as it is."""
    return F.when(address == NO_VALUE, address).otherwise(mask_address(address))
