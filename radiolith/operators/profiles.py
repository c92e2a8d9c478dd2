"""Profiles: which warnings to escalate or suppress, and private dictionaries; composed before any data is read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolith.functions import tags as T
from radiolith.functions.charset import WITHHELD
from radiolith.functions.values import KNOWN_VRS

from .diagnostics import CODES

_KEY = re.compile(r"[0-9A-F]{4}XX[0-9A-F]{2}")


class ProfileError(ValueError):
    """A profile that cannot be."""


@dataclass(frozen=True)
class Profile:
    name: str
    lineage: tuple[str, ...]
    description: str | None = None
    escalate: frozenset[str] = frozenset()
    suppress: frozenset[str] = frozenset()
    private: dict[str, dict[str, tuple[str, str, str]]] = field(default_factory=dict)

    def describe(self) -> str:
        tags = sum(map(len, self.private.values()))
        return f"{' > '.join(self.lineage)}: {len(self.escalate)} escalated, {len(self.suppress)} suppressed, {tags} private tags of {len(self.private)} creators"

    def private_table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, c, k, *d) for c, keys in self.private.items() for k, d in keys.items()]
        return spark.createDataFrame(rows, "profile string, creator string, key string, vr string, keyword string, name string")


def define_profile(name: str, description: str | None = None, escalate=(), suppress=(), private: dict[str, dict[str, tuple[str, str, str]]] | None = None, extends: tuple[Profile, ...] = ()) -> Profile:
    """A checked profile; parents come first, what is said here wins, and a code is never both escalated and suppressed."""
    if not isinstance(name, str) or not name.strip():
        raise ProfileError("a profile needs a name")
    for code in (*escalate, *suppress):
        if code not in CODES:
            raise ProfileError("unknown warning code")
    for creator, keys in (private or {}).items():
        if not creator.strip():
            raise ProfileError("a private creator needs a name")
        for key, (vr, keyword, label) in keys.items():
            if not _KEY.fullmatch(key) or int(key[3], 16) % 2 == 0:
                raise ProfileError("a private key is an odd group, XX and a byte")
            if vr not in KNOWN_VRS or not keyword or not label:
                raise ProfileError("a private tag needs a known representation, a keyword and a name")
    up, down, dictionary, lineage = set(), set(), {}, []
    for parent in extends:
        up |= parent.escalate
        down |= parent.suppress
        lineage += [x for x in parent.lineage if x not in lineage]
        for c, keys in parent.private.items():
            dictionary[c] = dictionary.get(c, {}) | keys
    for c, keys in (private or {}).items():
        dictionary[c] = dictionary.get(c, {}) | keys
    up |= set(escalate)
    down |= set(suppress)
    if up & down:
        raise ProfileError("a code is both escalated and suppressed")
    text = description if description is not None else next((p.description for p in extends), None)
    return Profile(name, (*lineage, name), text, frozenset(up), frozenset(down), dictionary)


def resolve_private(rows: DataFrame, profile: Profile, tag: str = "tag", creator: str = "private_creator") -> DataFrame:
    """Adds ``private_vr``, ``private_keyword`` and ``shown_creator`` by the profile's dictionary; a creator that it does not name is withheld."""
    table = F.broadcast(profile.private_table(rows.sparkSession).select(F.col("creator").alias("_c"), F.col("key").alias("_k"), F.col("vr").alias("private_vr"), F.col("keyword").alias("private_keyword")))
    met = rows.join(table, (F.col(creator) == F.col("_c")) & (T.canonical_private_key(F.col(tag)) == F.col("_k")), "left").drop("_c", "_k")
    known = F.col(creator).isin(*profile.private) if profile.private else F.lit(False)
    return met.withColumn("shown_creator", F.when(F.col(creator).isNull() | known, F.col(creator)).otherwise(F.lit(WITHHELD)))


# vendors' published private dictionaries, and which codes the presets take.
GE = define_profile("ge", "GE MR private blocks", private={
    "GEMS_IDEN_01": {"0009XX01": ("LO", "FullFidelity", "Full Fidelity"), "0009XX02": ("SH", "SuiteId", "Suite Id"), "0009XX04": ("SH", "ProductId", "Product Id")},
    "GEMS_ACQU_01": {"0019XX9C": ("LO", "PulseSequenceName", "Pulse Sequence Name"), "0019XX9E": ("LO", "InternalPulseSequenceName", "Internal Pulse Sequence Name"), "0019XXBB": ("DS", "DiffusionDirectionX", "Diffusion Direction X"), "0019XXBC": ("DS", "DiffusionDirectionY", "Diffusion Direction Y"), "0019XXBD": ("DS", "DiffusionDirectionZ", "Diffusion Direction Z")},
    "GEMS_PARM_01": {"0043XX39": ("IS", "DiffusionBValue", "Diffusion B-Value")},
})
SIEMENS = define_profile("siemens", "Siemens CSA and MEDCOM private blocks", private={
    "SIEMENS CSA HEADER": {"0029XX10": ("OB", "CSAImageHeaderInfo", "CSA Image Header Info"), "0029XX20": ("OB", "CSASeriesHeaderInfo", "CSA Series Header Info")},
    "SIEMENS CSA NON-IMAGE": {"0029XX10": ("OB", "CSADataInfo", "CSA Data Info")},
    "SIEMENS MEDCOM HEADER": {"0029XX08": ("CS", "MedComHeaderType", "MedCom Header Type"), "0029XX09": ("LO", "MedComHeaderVersion", "MedCom Header Version"), "0029XX10": ("OB", "MedComHeaderInfo", "MedCom Header Info"), "0029XX20": ("OB", "MedComHistoryInformation", "MedCom History Information")},
})
PHILIPS = define_profile("philips", "Philips MR private blocks", private={
    "Philips Imaging DD 001": {"2001XX03": ("FL", "DiffusionBFactor", "Diffusion B-Factor"), "2001XX04": ("CS", "DiffusionDirection", "Diffusion Direction"), "2001XX81": ("IS", "NumberOfDynamicScans", "Number Of Dynamic Scans")},
    "Philips MR Imaging DD 001": {"2005XXB0": ("FL", "DiffusionDirectionRL", "Diffusion Direction RL"), "2005XXB1": ("FL", "DiffusionDirectionAP", "Diffusion Direction AP"), "2005XXB2": ("FL", "DiffusionDirectionFH", "Diffusion Direction FH")},
})
STRICT = define_profile("strict", "What touches integrity is an error", escalate=("FILE_META_GROUP_LENGTH_MISMATCH", "PIXEL_DATA_LENGTH_MISMATCH", "VR_MISMATCH", "UNDEFINED_LENGTH_IN_EXPLICIT_VR", "NONZERO_RESERVED_BYTES", "PRIVATE_TAG_NO_CREATOR", "UN_PARSED_AS_SQ"))
LENIENT = define_profile("lenient", "Frequent cosmetic warnings are dropped", suppress=("MISSING_PREAMBLE", "ODD_LENGTH_VALUE_PADDED", "GROUP_LENGTH_IN_DATASET", "UI_TRAILING_SPACE", "TRAILING_NULL_IN_TEXT_VR", "FILE_META_GROUP_LENGTH_MISSING"))
PROFILES = {p.name: p for p in (GE, SIEMENS, PHILIPS, STRICT, LENIENT)}
