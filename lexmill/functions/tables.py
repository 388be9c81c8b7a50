"""Names, abbreviations and patterns that legal citations are written with."""

from __future__ import annotations

# Reporters, as they are abbreviated.
REPORTERS = (
    "Cal.5th", "Cal. 5th", "Cal.4th", "Cal. 4th", "Cal.3d", "Cal. 3d", "Cal.2d", "Cal. 2d", "Cal.",
    "Cal.App.5th Supp.", "Cal. App. 5th Supp.", "Cal.App.4th Supp.", "Cal. App. 4th Supp.",
    "Cal.App.3d Supp.", "Cal. App. 3d Supp.", "Cal.App.2d Supp.", "Cal. App. 2d Supp.",
    "Cal.App.5th", "Cal. App. 5th", "Cal.App.4th", "Cal. App. 4th", "Cal.App.3d", "Cal. App. 3d",
    "Cal.App.2d", "Cal. App. 2d", "Cal.App.", "Cal. App.",
    "Cal.Rptr.3d", "Cal. Rptr. 3d", "Cal.Rptr.2d", "Cal. Rptr. 2d", "Cal.Rptr.", "Cal. Rptr.",
    "U.S.", "S.Ct.", "S. Ct.", "L.Ed.2d", "L. Ed. 2d", "L.Ed.", "L. Ed.",
    "F.4th", "F. 4th", "F.3d", "F. 3d", "F.2d", "F. 2d", "F.",
    "F.Supp.3d", "F. Supp. 3d", "F.Supp.2d", "F. Supp. 2d", "F.Supp.", "F. Supp.",
    "F. App'x", "F. App’x", "F.App'x", "F.App’x",
    "N.Y.2d", "N.Y. 2d", "N.Y.3d", "N.Y. 3d", "P.3d", "P. 3d", "P.2d", "P. 2d", "P.",
    "A.3d", "A. 3d", "A.2d", "A. 2d", "N.E.3d", "N.E. 3d", "N.E.2d", "N.E. 2d", "N.W.2d", "N.W. 2d",
    "S.E.2d", "S.E. 2d", "S.W.3d", "S.W. 3d", "S.W.2d", "S.W. 2d", "So.3d", "So. 3d", "So.2d", "So. 2d",
)

# Statute codes as they are named, and their abbreviations.
CODES = (
    (r"Code of Civil Procedure", "CCP"),
    (r"Civil Code", "CIV"),
    (r"Penal Code", "PEN"),
    (r"Evidence Code", "EVID"),
    (r"Business (?:and|&) Professions Code", "BPC"),
    (r"Family Code", "FAM"),
    (r"Government Code", "GOV"),
    (r"Health (?:and|&) Safety Code", "HSC"),
    (r"Labor Code", "LAB"),
    (r"Probate Code", "PROB"),
    (r"Vehicle Code", "VEH"),
    (r"Welfare (?:and|&) Institutions Code", "WIC"),
    (r"Corporations Code", "CORP"),
    (r"Insurance Code", "INS"),
    (r"Revenue (?:and|&) Taxation Code", "RTC"),
    (r"Education Code", "EDC"),
    (r"Elections Code", "ELEC"),
    (r"Financial Code", "FIN"),
    (r"Fish (?:and|&) Game Code", "FGC"),
    (r"Food (?:and|&) Agricultural Code", "FAC"),
    (r"Harbors (?:and|&) Navigation Code", "HNC"),
    (r"Military (?:and|&) Veterans Code", "MVC"),
    (r"Public Contract Code", "PCC"),
    (r"Public Resources Code", "PRC"),
    (r"Public Utilities Code", "PUC"),
    (r"Streets (?:and|&) Highways Code", "SHC"),
    (r"Unemployment Insurance Code", "UIC"),
    (r"Water Code", "WAT"),
    (r"Commercial Code", "COM"),
    (r"Code Civ\.\s*Proc\.", "CCP"),
    (r"Civ\.\s*Code", "CIV"),
    (r"Pen\.\s*Code", "PEN"),
    (r"Evid\.\s*Code", "EVID"),
    (r"Bus\.\s*(?:&|and)\s*Prof\.\s*Code", "BPC"),
    (r"Fam\.\s*Code", "FAM"),
    (r"Gov\.\s*Code", "GOV"),
    (r"Health\s*(?:&|and)\s*Saf\.\s*Code", "HSC"),
    (r"Lab\.\s*Code", "LAB"),
    (r"Prob\.\s*Code", "PROB"),
    (r"Veh\.\s*Code", "VEH"),
    (r"Welf\.\s*(?:&|and)\s*Inst\.\s*Code", "WIC"),
    (r"Corp\.\s*Code", "CORP"),
    (r"Ins\.\s*Code", "INS"),
    (r"Rev\.\s*(?:&|and)\s*Tax\.\s*Code", "RTC"),
    (r"Educ\.\s*Code", "EDC"),
    (r"Elec\.\s*Code", "ELEC"),
    (r"Fin\.\s*Code", "FIN"),
    (r"Fish\s*(?:&|and)\s*Game Code", "FGC"),
    (r"Food\s*(?:&|and)\s*Agric\.\s*Code", "FAC"),
    (r"Harb\.\s*(?:&|and)\s*Nav\.\s*Code", "HNC"),
    (r"Mil\.\s*(?:&|and)\s*Vet\.\s*Code", "MVC"),
    (r"Pub\.\s*Cont(?:ract)?\.?\s*Code", "PCC"),
    (r"Pub\.\s*Res(?:ources)?\.?\s*Code", "PRC"),
    (r"Pub\.\s*Util(?:ities)?\.?\s*Code", "PUC"),
    (r"Sts\.\s*(?:&|and)\s*Hy\.\s*Code", "SHC"),
    (r"Unemp\.\s*Ins\.\s*Code", "UIC"),
    (r"Wat\.\s*Code", "WAT"),
    (r"Com\.\s*Code", "COM"),
    (r"Govt\.\s*Code", "GOV"),
    (r"Fish\s*(?:&|and)\s*G\.\s*Code", "FGC"),
    (r"Food\s*(?:&|and)\s*Agr\.\s*Code", "FAC"),
    (r"Civ\.\s*Proc\.\s*Code", "CCP"),
    (r"Civil\s+Procedure\s+Code", "CCP"),
    (r"C\.?C\.?P\.?", "CCP"),
    (r"CIV", "CIV"),
    (r"PEN", "PEN"),
    (r"EVID", "EVID"),
    (r"BPC", "BPC"),
    (r"FAM", "FAM"),
    (r"GOV", "GOV"),
    (r"HSC", "HSC"),
    (r"LAB", "LAB"),
    (r"PROB", "PROB"),
    (r"VEH", "VEH"),
    (r"WIC", "WIC"),
    (r"CORP", "CORP"),
    (r"INS", "INS"),
    (r"RTC", "RTC"),
    (r"EDC", "EDC"),
    (r"ELEC", "ELEC"),
    (r"FIN", "FIN"),
    (r"FGC", "FGC"),
    (r"HNC", "HNC"),
    (r"MVC", "MVC"),
    (r"PCC", "PCC"),
    (r"PRC", "PRC"),
    (r"PUC", "PUC"),
    (r"SHC", "SHC"),
    (r"UIC", "UIC"),
    (r"WAT", "WAT"),
    (r"COM", "COM"),
)

# How the two providers name the codes in searches.
WESTLAW = {
    "BPC": "CA BUS & PROF", "COM": "CA COML", "CIV": "CA CIVIL", "CCP": "CA CIV PRO", "CORP": "CA CORP",
    "EDC": "CA EDUC", "ELEC": "CA ELEC", "EVID": "CA EVID", "FAM": "CA FAM", "FIN": "CA FIN",
    "FGC": "CA FISH & G", "FAC": "CA FOOD & AG", "GOV": "CA GOVT", "HNC": "CA HARB & NAV",
    "HSC": "CA HLTH & S", "INS": "CA INS", "LAB": "CA LABOR", "MVC": "CA MIL & VET", "PEN": "CA PENAL",
    "PROB": "CA PROBATE", "PCC": "CA PUB CONT", "PRC": "CA PUB RES", "PUC": "CA PUB UTIL",
    "RTC": "CA REV & TAX", "SHC": "CA STR & HWY", "UIC": "CA UNEMP INS", "VEH": "CA VEHICLE",
    "WAT": "CA WATER", "WIC": "CA WELF & INST",
}
LEXIS = {
    "BPC": "Cal Bus & Prof Code", "COM": "Cal U Com Code", "CIV": "Cal Civ Code", "CCP": "Cal Code Civ Proc",
    "CORP": "Cal Corp Code", "EDC": "Cal Ed Code", "ELEC": "Cal Elec Code", "EVID": "Cal Evid Code",
    "FAM": "Cal Fam Code", "FIN": "Cal Fin Code", "FGC": "Cal Fish & G Code", "FAC": "Cal Food & Agr Code",
    "GOV": "Cal Gov Code", "HNC": "Cal Harb & Nav Code", "HSC": "Cal Health & Saf Code",
    "INS": "Cal Ins Code", "LAB": "Lab Code", "MVC": "Cal Mil & Vet Code", "PEN": "Cal Pen Code",
    "PROB": "Cal Prob Code", "PCC": "Cal Pub Contract Code", "PRC": "Cal Pub Resources Code",
    "PUC": "Cal Pub Util Code", "RTC": "Cal Rev & Tax Code", "SHC": "Cal Sts & Hy Code",
    "UIC": "Cal Unemp Ins Code", "VEH": "Cal Veh Code", "WAT": "Cal Wat Code", "WIC": "Cal Welf & Inst Code",
}
WESTLAW_SEARCH = "https://1.next.westlaw.com/Search/Results.html?query="
WESTLAW_DOCUMENT = "https://1.next.westlaw.com/Link/Document/FullText?findType=Y&cite="
LEXIS_SEARCH = "https://plus.lexis.com/search/?pdmfid=1530671&pdsearchterms="

# Words that end, join or precede the name of a party.
SIGNALS = frozenset(("see", "cf", "cf.", "per", "in", "but", "compare", "accord", "e.g.", "also", "n", "of", "the", "and", "to", "by", "for", "with", "from", "as", "if", "when", "while", "since", "because", "though", "although", "court", "supreme", "federal", "state", "california"))
CONNECTORS = frozenset(("of", "the", "and", "&", "de", "la", "du", "von", "van", "re", "ex", "rel"))
ABBREVIATIONS = frozenset(("co.", "inc.", "corp.", "ltd.", "ass'n.", "rel."))
STOPPERS = frozenset(("e.g", "i.e", "cf", "etc", "viz", "supra", "eg", "ie", "see", "accord", "compare"))
HEADINGS = frozenset(("cases", "statutes", "rules", "authorities", "treatises", "regulations", "constitutional", "miscellaneous"))
COMPANY_LOWER = frozenset(("inc", "co", "corp", "ltd", "grp", "ass'n", "assn", "lp"))
COMPANY_UPPER = frozenset(("LLC", "LLP", "LP", "LLLP", "PLLC", "PC", "PLC"))
FIRMS = frozenset(("LLP", "LLC", "LLLP", "PLLC", "PC", "PLC"))
NUMBERED = frozenset(("local", "loc", "no", "chapter", "ch"))
TAIL_REACH = 80

#: Where an ASCII word begins or ends, before or after one of its characters.
FROM, TO = r"(?<!\w)", r"(?!\w)"

# The patterns of citations. \s is white space as browsers have it.
NO_V = r"In [Rr][Ee]|IN RE|Estate of|Guardianship of|Conservatorship of|Adoption of|Marriage of"
REPORTER = "|".join(r.replace(".", r"\.") for r in sorted(REPORTERS, key=len, reverse=True))
PINNED = rf"(\d{{1,4}})\s+({REPORTER})\s+(\d{{1,5}})(?:,\s*\d{{1,5}}(?:[\-‒–—−]\d{{1,5}})?)?"
YEAR = rf"\((?:[^)]*?{FROM})?(\d{{4}})\)"
AT = r"(?:,\s*at\s+\*?\d+(?:\s+n\.\d+)?)?"
TAILS = {
    "csm": rf"\s*{YEAR}\s+{PINNED}",
    "bb": rf",\s+{PINNED}\s*,?\s*{YEAR}",
    "wl": rf",\s+(\d{{4}})\s+WL\s+(\d{{4,8}}){AT}\s*{YEAR}",
    "lexis": rf",\s+(\d{{4}})\s+U\.S\.\s*Dist\.\s*LEXIS\s+(\d{{4,8}}){AT}\s*{YEAR}",
    "flat": rf"\s+{PINNED}\s*,?\s*{YEAR}",
    "slip": r"(?i:,?\s+Case\s+No\.\s+([A-Z0-9][A-Z0-9:\-]{3,30})\s*\(([^)]{3,80})\))",
}
BARE = rf"(\d{{1,4}})\s+({REPORTER})\s+(\d{{1,5}})"
NON_V_CASE = (
    rf"{FROM}({NO_V})\s+([A-Z][A-Za-z0-9.\-'’&, ]+?)\s*(?:{YEAR}\s+{BARE}|,?\s+{BARE}\s*{YEAR}"
    rf"|[,\s][^\n]{{0,80}}?,\s+(\d{{4}})\s+WL\s+(\d{{4,8}}){AT}\s*{YEAR})"
)
CASES = rf"{FROM}((?!(?:The|In|See|Cf|But){TO})[A-Z][a-z][A-Za-z]*(?:\s+[A-Z][a-z][A-Za-z]*){{1,5}}\s+Cases)\s*(?:{YEAR}\s+{BARE}|,?\s+{BARE}\s*{YEAR})"
SUPRA = rf"{FROM}((?:(?:{NO_V})\s+)?[A-Z][A-Za-z0-9.\-'’&]+(?:\s+v\.\s+[A-Z][A-Za-z0-9.\-'’&]+)?),\s*supra{TO}"
SECTION = r"\d+(?:\.\d+)?[a-z]?(?:\([a-z0-9]+\))*"
SIGN = r"(?:§§?|sections?|secs?\.?)\s*"


def by_letter(patterns: list[str]) -> str:
    """Alternatives under their first letters, which they all begin with; in order for each."""
    return "|".join(f"{c}(?:{'|'.join(p[1:] for p in patterns if p[0] == c)})" for c in sorted({p[0] for p in patterns}))


CODE = by_letter([p for p, _ in sorted(CODES, key=lambda c: -len(c[0]))])
AND = r"\s*(?:,\s*and|,|\s+and)\s+"
STATUTE = rf"(?i){FROM}(?:Cal\.\s*|California\s+)?({CODE}),?\s*{SIGN}({SECTION})((?:{AND}{SECTION})*)"
FEDERAL = rf"(?i){FROM}(\d{{1,3}})\s+U\.\s*S\.\s*C\.(?:\s*App\.)?\s*{SIGN}({SECTION})"
UNIFORM = rf"(?i){FROM}(?:U\.?\s*C\.?\s*C\.?|Unif(?:orm)?\.?\s*Commercial\s+Code|Commercial\s+Code|Com\.\s*Code),?\s*{SIGN}(\d+-\d+(?:\([a-z0-9]+\))*)"
COURT_RULE = rf"(?i){FROM}(?:Cal\.\s*Rules?\s*of\s*Court|California\s*Rules?\s*of\s*Court),?\s*rules?\s+(\d+(?:\.\d+)*)(?:\([a-z0-9]+\))*"
CONDUCT_RULE = rf"(?i){FROM}(?:Cal(?:ifornia)?\.?\s+)?Rules?\s+of\s+(?:Prof(?:essional)?\.?\s+)?Conduct\s+(\d+(?:\.\d+)*)(?:\([a-z0-9]+\))*"
NUMBER = r"(?:VF[-\s]?)?\d{3,4}[A-Z]?"
INSTRUCTION = rf"(?i){FROM}CACI{TO}[\s),]*(?:Nos?\.?\s*)?({NUMBER})((?:{AND}{NUMBER})*)"
PARTY = r"[A-Z][A-Za-z0-9.\-'’&]*"
SHORT_FORM = rf"{FROM}({PARTY}(?:\s+{PARTY}){{0,3}})\s+v\.\s+({PARTY}(?:\s+{PARTY}){{0,4}}(?:,\s*(?:Inc|LLC|LLP|Ltd|Corp|Co)\.?)?)"
LEAD = r"(?i)^(?:In|See|Cf|Cf\.|Compare|Accord|But|Following|Per|Under|Like|Citing|Quoting)\s+"

#: White space as browsers have it, inside a class.
WHITE = r"\x09-\x0D\x20   -     　﻿"


#: White space that Java's \s does not know.
WIDE_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def java(pattern: str) -> str:
    """A pattern of this module for Java's engine: white space and word edges spelled out. Texts
    without WIDE_SPACES don't need it."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif two == r"\S":
            out.append(f"[^{WHITE}]")
        elif two == r"\b":
            out.append(r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")
        elif two[:1] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)
