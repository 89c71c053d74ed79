"""Parameters and fixed vocabularies of the analytic operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Eras as (name, first year, last year, label).
ERAS = {
    "break4": [
        ("pre_song", -10_000, 959, "Before Song"),
        ("song_to_yuan", 960, 1278, "Song to Yuan"),
        ("yuan_to_ming", 1279, 1367, "Yuan to Ming"),
        ("ming_to_qing", 1368, 1911, "Ming to Qing"),
    ],
    "break3": [
        ("cluster1_song_and_before", -10_000, 1278, "Song and before"),
        ("cluster2_yuan_ming", 1279, 1643, "Yuan and Ming"),
        ("cluster3_qing_after", 1644, 3000, "Qing and after"),
    ],
}
# Dynastic transitions, in the order in which ties are settled.
TRANSITION_YEARS = [220, 589, 618, 907, 960, 1127, 1279, 1368, 1644, 1912]
# Entry codes by category.
ENTRY_CODES = {
    "has_civil_exam": [26, 28, 29, 36, 37, 39, 42, 47, 48, 49, 50, 51, 52, 53, 54, 56, 57],
    "has_technical_exam": [43, 44, 46, 328],
    "has_recommendation": [101, 225, 310, 319],
    "has_yin_privilege": [8, 59, 60, 62, 118, 138, 157, 163, 197, 198, 317, 318],
    "has_purchase_or_direct": [7, 13, 14, 15],
}
# Words that mark a technical office.
TECHNICAL_WORDS = (
    "工部", "司天", "欽天", "钦天", "太醫", "太医", "都水", "軍器", "军器", "將作", "将作", "天文", "算學", "算学", "算曆", "算历", "曆算", "历算",
    "造曆", "造历", "醫官", "医官", "醫學", "医学", "醫正", "医正", "醫生", "医生", "醫士", "医士", "醫人", "医人", "御醫", "御医", "翰林醫", "翰林医",
    "翰林天文", "河道", "水利", "繕工", "缮工", "百工", "營繕", "营缮",
)
# Bureaus by the words in an office's name; the first that matches counts.
BUREAUS = {
    "astronomical": "司天|欽天|钦天|天文|算學|算学|算曆|算历|曆算|历算|造曆|造历|推算|靈臺|灵台",
    "medical": "太醫|太医|醫官|医官|醫學|医学|醫正|医正|醫生|医生|醫士|医士|醫人|医人|御醫|御医|翰林醫|翰林医",
    "hydraulic": "都水|河道|水利",
    "military_industrial": "軍器|军器|兵器|火器|器械",
    "construction": "將作|将作|繕工|缮工|百工|營繕|营缮|修造|土木",
    "works_general": "工部",
}
BUREAU_FLAGS = ["astronomical", "medical", "hydraulic", "military_industrial", "construction"]
# Words of high offices, and of offices that only sound like them.
HIGH_WORDS = (
    "同中書門下二品", "同中书门下二品", "同中書門下三品", "同中书门下三品", "同中書門下平章事", "同中书门下平章事", "同鳳閣鸞臺", "同凤阁鸾台", "平章事", "中書令", "中书令",
    "尚書令", "尚书令", "侍中", "門下侍郎", "门下侍郎", "丞相", "宰相", "參知政事", "参知政事", "內閣大學士", "内阁大学士", "内阁大學士", "軍機大臣", "军机大臣",
)
NOT_HIGH_WORDS = (
    "內閣中書", "内阁中书", "中書舍人", "中书舍人", "中書省", "中书省", "中書檢正", "中书检正", "門下省", "门下省", "中書五房", "中书五房", "書令史", "令史",
    "習學", "习学", "孔目", "吏房", "戶房", "户房", "禮房", "礼房", "刑房", "兵房", "工房", "開拆", "章奏", "催驅", "点檢", "點檢",
)
# Domains by substrings of an office's names in any language; the first that matches counts.
DOMAINS = {
    "astronomical": (
        "司天", "太史", "欽天", "天文", "曆", "历", "astronom", "astrolog", "calendar", "observatory",
    ),
    "medical": (
        "醫", "藥", "太醫", "medicine", "medical", "physician", "doctor", "pharmacy",
    ),
    "hydraulic": (
        "都水", "水部", "水利", "河", "漕", "waterway", "irrigation", "river", "canal",
    ),
    "military_industrial": (
        "軍器", "火器", "兵器", "武器", "armament", "armory", "weapon", "military",
    ),
    "construction": (
        "工部", "將作", "營造", "修造", "works", "construction", "building", "architecture",
    ),
}


@dataclass(frozen=True)
class BreakSearch:
    """Settings of the structural-break search."""

    start_year: int = 600
    end_year: int = 1912
    bin_years: int = 50
    max_breaks: int = 5
    min_segment_bins: int = 2
    min_segment_rows: int = 120
    tolerance_years: int = 50


@dataclass(frozen=True)
class Spatial:
    """Settings of the spatial statistics."""

    neighbours: int = 8
    permutations: int = 999
    seed: int = 20260608
    top_places: int = 10
    iterations: int = 5000
    l2: float = 1e-4


@dataclass(frozen=True)
class Network:
    """Settings of the network stage."""

    scheme: str = "break4"
    mode: str = "induced"
    max_distance: int = 6
    max_paths: int = 8
    pivots: int = 512
    seed: int = 20260516


@dataclass(frozen=True)
class Careers:
    """Settings of the career stage."""

    types: int = 6
    iterations: int = 100
    clusters: list[str] = field(default_factory=lambda: [e[0] for e in ERAS["break3"]])


#: The clusters of the analyses, in their order.
CLUSTERS = [e[0] for e in ERAS["break3"]]
