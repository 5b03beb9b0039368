"""Source reliability and independence: ordered rules over a source's name, then over the host of its URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrob.functions.columns import first_match, host_of

# Rules, in order; the first that matches wins. Names match whole words in any case, but for AP.
TIER_WEIGHTS = {"high": 1.0, "medium": 0.75, "low": 0.5}
CONFIDENCE_WEIGHTS = {"official": 1.0, "reported": 0.78, "estimated": 0.55}
NAME_TIERS = [
    (r"(?i)\b(UNODC|INCB|WHO|OHCHR|OCHA|UNDP|UNHCR|World Bank)\b", "high"),
    (r"(?i)\b(ACLED|International Crisis Group|Crisis Group|IISS|USIP|GI-TOC|Global Initiative)\b", "high"),
    (r"(?i)\b(CDC|NCHS|VSRR|NIDA|SAMHSA|OFAC|DEA|HIDTA|EUDA|EMCDDA|ACIC|Conflict Armament Research|Small Arms Survey)\b", "high"),
    (r"(?i)\b(C4ADS|OCCRP|RAND|Stimson|Global Financial Integrity|The Sentry|Global Witness|Fortify Rights|TRAFFIC|EIA|Environmental Investigation Agency|InSight Crime)\b", "medium"),
    (r"(?i)\b(Radio Free Asia|RFA|Frontier Myanmar|The Irrawaddy|Myanmar Now|Reuters|AP|AFP|BBC)\b", "medium"),
    (r"(?i)\b(GASO|Global Anti-Scam|WildLeaks)\b", "low"),
]
HOST_TIERS = [
    (r"\.(gov|int)$", "high"),
    (r"(^|\.)(unodc|incb|who|un|undp|unhcr|worldbank)\.org$", "high"),
    (r"(^|\.)(acleddata|crisisgroup|iiss|globalinitiative)\.(org|net)$", "high"),
    (r"\.(org|edu)$", "medium"),
]
NAME_FAMILIES = [
    (r"(?i)\bUNODC\b", "unodc"), (r"(?i)\bINCB\b", "incb"), (r"(?i)\bWHO\b", "who"), (r"(?i)\bOHCHR\b", "ohchr"), (r"(?i)\bOCHA\b", "ocha"),
    (r"(?i)\bUNDP\b", "undp"), (r"(?i)\bUNHCR\b", "unhcr"), (r"(?i)\bWorld Bank\b", "world-bank"), (r"(?i)\bACLED\b", "acled"),
    (r"(?i)\b(International Crisis Group|Crisis Group)\b", "crisis-group"), (r"(?i)\bIISS\b", "iiss"), (r"(?i)\bUSIP\b", "usip"),
    (r"(?i)\b(GI-TOC|Global Initiative)\b", "gi-toc"), (r"(?i)\b(CDC|NCHS|VSRR)\b", "cdc"), (r"(?i)\b(OFAC|Treasury)\b", "ofac"), (r"(?i)\bDEA\b", "dea"),
    (r"(?i)\bHIDTA\b", "hidta"), (r"(?i)\b(SAMHSA|NIDA)\b", "hhs-research"), (r"(?i)\b(EUDA|EMCDDA)\b", "euda"),
    (r"(?i)\b(ACIC|Australian Criminal Intelligence|NWDMP)\b", "acic"), (r"(?i)\bC4ADS\b", "c4ads"), (r"(?i)\bOCCRP\b", "occrp"), (r"(?i)\bRAND\b", "rand"),
    (r"(?i)\bStimson\b", "stimson"), (r"(?i)\bGlobal Financial Integrity\b", "gfi"), (r"(?i)\bThe Sentry\b", "the-sentry"), (r"(?i)\bGlobal Witness\b", "global-witness"),
    (r"(?i)\bFortify Rights\b", "fortify-rights"), (r"(?i)\bTRAFFIC\b", "traffic"), (r"(?i)\b(EIA|Environmental Investigation Agency)\b", "eia"),
    (r"(?i)\bConflict Armament Research\b", "conflict-armament-research"), (r"(?i)\bSmall Arms Survey\b", "small-arms-survey"), (r"(?i)\bInSight Crime\b", "insight-crime"),
    (r"(?i)\b(GASO|Global Anti-Scam)\b", "gaso"), (r"(?i)\b(Radio Free Asia|RFA)\b", "rfa"), (r"(?i)\bFrontier Myanmar\b", "frontier-myanmar"),
    (r"(?i)\bThe Irrawaddy\b", "irrawaddy"), (r"(?i)\bMyanmar Now\b", "myanmar-now"), (r"(?i)\bReuters\b", "reuters"), (r"\bAP\b", "ap"), (r"(?i)\bAFP\b", "afp"), (r"(?i)\bBBC\b", "bbc"),
]
HOST_FAMILIES = [
    (r"(^|\.)unodc\.org$", "unodc"), (r"(^|\.)incb\.org$", "incb"), (r"(^|\.)who\.int$", "who"), (r"(^|\.)ohchr\.org$", "ohchr"), (r"(^|\.)unocha\.org$", "ocha"),
    (r"(^|\.)undp\.org$", "undp"), (r"(^|\.)unhcr\.org$", "unhcr"), (r"(^|\.)worldbank\.org$", "world-bank"), (r"(^|\.)acleddata\.com$", "acled"),
    (r"(^|\.)crisisgroup\.org$", "crisis-group"), (r"(^|\.)iiss\.org$", "iiss"), (r"(^|\.)usip\.org$", "usip"), (r"(^|\.)globalinitiative\.net$", "gi-toc"),
    (r"(^|\.)cdc\.gov$", "cdc"), (r"(^|\.)(treasury|treas)\.gov$", "ofac"), (r"(^|\.)dea\.gov$", "dea"), (r"(^|\.)(euda|emcdda)\.europa\.eu$", "euda"),
    (r"(^|\.)acic\.gov\.au$", "acic"), (r"(^|\.)c4ads\.org$", "c4ads"), (r"(^|\.)occrp\.org$", "occrp"), (r"(^|\.)rand\.org$", "rand"), (r"(^|\.)stimson\.org$", "stimson"),
    (r"(^|\.)gfintegrity\.org$", "gfi"), (r"(^|\.)thesentry\.org$", "the-sentry"), (r"(^|\.)globalwitness\.org$", "global-witness"), (r"(^|\.)fortifyrights\.org$", "fortify-rights"),
    (r"(^|\.)traffic\.org$", "traffic"), (r"(^|\.)eia-international\.org$", "eia"), (r"(^|\.)conflictarm\.com$", "conflict-armament-research"),
    (r"(^|\.)smallarmssurvey\.org$", "small-arms-survey"), (r"(^|\.)insightcrime\.org$", "insight-crime"), (r"(^|\.)gaso\.world$", "gaso"), (r"(^|\.)rfa\.org$", "rfa"),
    (r"(^|\.)frontiermyanmar\.net$", "frontier-myanmar"), (r"(^|\.)irrawaddy\.com$", "irrawaddy"), (r"(^|\.)myanmar-now\.org$", "myanmar-now"),
    (r"(^|\.)reuters\.com$", "reuters"), (r"(^|\.)apnews\.com$", "ap"), (r"(^|\.)afp\.com$", "afp"), (r"(^|\.)bbc\.co\.?(uk|m)?$", "bbc"),
]


def reliability_tier(name: Column, url: Column) -> Column:
    return first_match(name, NAME_TIERS, first_match(host_of(url), HOST_TIERS, F.lit("low")))


def reliability_weight(name: Column, url: Column) -> Column:
    tier = reliability_tier(name, url)
    return F.when(tier == "high", TIER_WEIGHTS["high"]).when(tier == "medium", TIER_WEIGHTS["medium"]).otherwise(TIER_WEIGHTS["low"])


def source_family(name: Column, url: Column) -> Column:
    """One id for all names of an organisation, so that it counts once; unknown names keep their own."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+", " ")
    own = F.when(plain != "", F.concat(F.lit("name:"), plain)).otherwise("unknown")
    return first_match(name, NAME_FAMILIES, first_match(host_of(url), HOST_FAMILIES, own))


def family_label(family: Column) -> Column:
    return F.when(family.startswith("name:"), F.initcap(F.regexp_replace(family, "^name:", ""))).otherwise(F.upper(F.replace(family, F.lit("-"), F.lit(" "))))


def confidence_weight(confidence: Column) -> Column:
    return F.when(confidence == "official", CONFIDENCE_WEIGHTS["official"]).when(confidence == "reported", CONFIDENCE_WEIGHTS["reported"]).otherwise(CONFIDENCE_WEIGHTS["estimated"])


def _case(expr: str, rules: list[tuple[str, str]], default: str) -> str:
    return "case " + " ".join(f"when regexp_matches(coalesce({expr}, ''), '{p}') then '{v}'" for p, v in rules) + f" else {default} end"


HOST_SQL = "lower(nullif(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1), ''))"


def tier_sql(name: str, url: str) -> str:
    """The rules of ``reliability_tier`` as DuckDB SQL."""
    return _case(name, NAME_TIERS, _case(HOST_SQL.format(url=url), HOST_TIERS, "'low'"))


def family_sql(name: str, url: str) -> str:
    plain = f"regexp_replace(lower(trim(coalesce({name}, ''))), '\\s+', ' ', 'g')"
    return _case(name, NAME_FAMILIES, _case(HOST_SQL.format(url=url), HOST_FAMILIES, f"case when {plain} <> '' then 'name:' || {plain} else 'unknown' end"))
