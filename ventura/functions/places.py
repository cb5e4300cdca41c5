"""Countries, regions and registrable domains as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and two-letter codes of countries, by the name they stand for.
COUNTRY_NAMES = {
    "United States": "usa us|united states|united states of america", "United Kingdom": "uk gb|united kingdom|great britain|england", "United Arab Emirates": "uae ae",
    "South Korea": "kr korea|south korea|republic of korea", "China": "cn|china, people's republic of", "Israel": "il|israel (state of)", "Czech Republic": "cz czechia|czech republic",
    "Taiwan": "tw|taiwan, province of china", "Hong Kong": "hk|hong kong sar", "Vietnam": "vn|viet nam", "South Africa": "za|south africa", "Saudi Arabia": "sa|saudi arabia", "New Zealand": "nz|new zealand",
    "India": "in", "Germany": "de", "Canada": "ca", "France": "fr", "Singapore": "sg", "Australia": "au", "Sweden": "se", "Netherlands": "nl", "Brazil": "br", "Japan": "jp", "Switzerland": "ch", "Spain": "es",
    "Italy": "it", "Ireland": "ie", "Denmark": "dk", "Norway": "no", "Finland": "fi", "Belgium": "be", "Austria": "at", "Poland": "pl", "Portugal": "pt", "Russia": "ru", "Turkey": "tr", "Ukraine": "ua",
    "Mexico": "mx", "Argentina": "ar", "Colombia": "co", "Chile": "cl", "Nigeria": "ng", "Kenya": "ke", "Egypt": "eg", "Indonesia": "id", "Malaysia": "my", "Thailand": "th", "Philippines": "ph", "Estonia": "ee",
    "Latvia": "lv", "Lithuania": "lt", "Hungary": "hu", "Romania": "ro", "Greece": "gr el", "Bulgaria": "bg", "Croatia": "hr", "Serbia": "rs", "Qatar": "qa", "Kuwait": "kw", "Pakistan": "pk", "Bangladesh": "bd",
    "Cyprus": "cy", "Slovenia": "si", "Slovakia": "sk", "Luxembourg": "lu", "Iceland": "is", "Malta": "mt", "Moldova": "md", "Morocco": "ma", "Tunisia": "tn", "Jordan": "jo", "Ghana": "gh", "Zambia": "zm",
}
#: Written form -> name: codes stand before the first bar, divided by blanks, full names behind bars.
ALIASES = {alias: name for name, listed in COUNTRY_NAMES.items() for alias in (*listed.split("|")[0].split(), *listed.split("|")[1:])}
#: Countries of each region, and the regions' continents.
REGIONS = {
    "North America": "United States, Canada",
    "Latin America": "Mexico, Brazil, Argentina, Chile, Colombia, Peru, Uruguay, Ecuador, Bolivia, Venezuela, Panama, Costa Rica, Guatemala, Jamaica, Dominican Republic, Puerto Rico, Paraguay, Honduras, El Salvador, Nicaragua, Cuba, Trinidad and Tobago",
    "Western Europe": "United Kingdom, Ireland, France, Germany, Netherlands, Belgium, Switzerland, Austria, Luxembourg, Monaco, Liechtenstein",
    "Northern Europe": "Sweden, Norway, Denmark, Finland, Iceland, Estonia, Latvia, Lithuania",
    "Southern Europe": "Spain, Portugal, Italy, Greece, Malta, Cyprus, San Marino, Andorra",
    "Central & Eastern Europe": "Poland, Czech Republic, Slovakia, Hungary, Romania, Bulgaria, Croatia, Slovenia, Serbia, Bosnia and Herzegovina, North Macedonia, Montenegro, Albania, Kosovo, Ukraine, Belarus, Moldova, Russia",
    "Middle East": "Israel, United Arab Emirates, Saudi Arabia, Qatar, Kuwait, Bahrain, Oman, Jordan, Lebanon, Turkey, Iran, Iraq, Palestine, Yemen, Syria",
    "North Africa": "Egypt, Morocco, Tunisia, Algeria, Libya, Sudan",
    "Sub-Saharan Africa": "Nigeria, Kenya, South Africa, Ghana, Ethiopia, Uganda, Tanzania, Rwanda, Senegal, Cameroon, Ivory Coast, Zambia, Zimbabwe, Botswana, Namibia, Mozambique, Angola, Benin, Mali, Malawi, Mauritius, Madagascar, Burkina Faso, Somalia, Congo, Democratic Republic of the Congo",
    "East Asia": "China, Japan, South Korea, Taiwan, Hong Kong, Macau, Mongolia, North Korea",
    "South Asia": "India, Pakistan, Bangladesh, Sri Lanka, Nepal, Bhutan, Maldives, Afghanistan",
    "Southeast Asia": "Singapore, Indonesia, Malaysia, Thailand, Vietnam, Philippines, Myanmar, Cambodia, Laos, Brunei",
    "Central Asia & Caucasus": "Kazakhstan, Uzbekistan, Georgia, Armenia, Azerbaijan, Kyrgyzstan, Tajikistan, Turkmenistan",
    "Oceania": "Australia, New Zealand, Fiji, Papua New Guinea",
}
CONTINENTS = {
    "Americas": ("North America", "Latin America"),
    "Europe": ("Western Europe", "Northern Europe", "Southern Europe", "Central & Eastern Europe"),
    "Asia": ("Middle East", "East Asia", "South Asia", "Southeast Asia", "Central Asia & Caucasus"),
    "Africa": ("North Africa", "Sub-Saharan Africa"),
    "Oceania": ("Oceania",),
}
#: Recognised countries; other values of a country column are cities, states or noise.
COUNTRIES = (
    "United States, United Kingdom, Canada, India, Israel, Germany, France, Australia, Singapore, Netherlands, Sweden, Switzerland, Brazil, Spain, Finland, Denmark, Norway, Japan, South Korea, China, Estonia, Poland, "
    "Ireland, Mexico, Colombia, Nigeria, South Africa, Kenya, Egypt, United Arab Emirates, Pakistan, Bangladesh, Indonesia, Portugal, Italy, Austria, Belgium, Czech Republic, Romania, Ukraine, Turkey, Argentina, Chile, "
    "New Zealand, Philippines, Vietnam, Thailand, Malaysia, Hong Kong, Taiwan, Greece, Hungary, Latvia, Lithuania, Russia, Peru, Ghana, Panama, Uganda, Ecuador, Morocco, Croatia, Jamaica, Senegal, Tanzania, Uruguay, "
    "Armenia, Jordan, Bolivia, Ethiopia, Luxembourg, Venezuela, Saudi Arabia, Qatar, Kuwait, Georgia, North Macedonia, Montenegro, Iceland, Belarus, Sri Lanka, Nepal, Mongolia, Lebanon, Cyprus, Kosovo, Slovakia, "
    "Bulgaria, Algeria, Namibia, Benin, Cameroon, Zambia, Slovenia, Serbia"
).split(", ")
REGION_OF = {country: region for region, listed in REGIONS.items() for country in listed.split(", ")}
CONTINENT_OF = {region: continent for continent, listed in CONTINENTS.items() for region in listed}
#: Endings of hosts that tell a country. Endings used as a brand (ai, io, co, eu, me) are left out.
COUNTRY_ENDINGS = {
    "GB": "co.uk org.uk me.uk", "AU": "com.au net.au org.au au", "JP": "co.jp jp", "BR": "com.br net.br br", "SG": "com.sg sg", "NZ": "co.nz nz", "KR": "co.kr kr", "IN": "co.in in", "IL": "co.il il", "ZA": "co.za za",
    "DE": "de", "FR": "fr", "NL": "nl", "SE": "se", "NO": "no", "DK": "dk", "FI": "fi", "BE": "be", "AT": "at", "CH": "ch", "IT": "it", "ES": "es", "PT": "pt", "PL": "pl", "CZ": "cz", "HU": "hu", "RO": "ro", "GR": "gr", "IE": "ie",
    "CN": "cn", "MX": "mx", "AR": "ar", "CL": "cl", "CA": "ca", "RU": "ru", "UA": "ua", "TR": "tr", "AE": "ae", "SA": "sa", "NG": "ng", "KE": "ke", "EG": "eg", "PK": "pk", "BD": "bd", "ID": "id", "MY": "my", "TH": "th", "VN": "vn",
    "PH": "ph", "TW": "tw", "HK": "hk", "EE": "ee", "LV": "lv", "LT": "lt",
}
ENDING_OF = {ending: code for code, listed in COUNTRY_ENDINGS.items() for ending in listed.split()}
#: Registries under which firms take names at the third level, by country; a stand-in for the public list, which is no part of this repository.
SECOND_LEVEL = {
    "uk": "ac co gov ltd me net nhs org plc", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt net org school", "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re", "in": "ac co edu firm gen gov ind net org res",
    "il": "ac co gov muni net org", "za": "ac co gov net org web", "br": "art com edu eng gov ind net org", "sg": "com edu gov net org per", "mx": "com edu gob net org", "tr": "com edu gov net org", "tw": "com edu gov net org", "hk": "com edu gov net org",
    "cn": "ac com edu gov net org", "ar": "com edu gob net org", "my": "com edu gov net org", "th": "ac co go in or", "id": "ac co go or web", "ua": "com edu gov net org", "pl": "com edu gov net org", "ph": "com edu gov net org", "vn": "com edu gov net org", "eg": "com edu gov org", "ng": "com edu gov org", "ke": "ac co go or",
}
#: Rules in the notation of public suffix lists: a name, ``*.`` for any label, ``!`` for an exception to that.
SUFFIX_RULES = (*(f"{sld}.{cc}" for cc, listed in SECOND_LEVEL.items() for sld in listed.split()), "*.ck", "!www.ck", "*.bd", "*.np", "*.mm", "*.kh", "*.er", "*.fk", "*.jm", "*.pg", "*.kawasaki.jp", "!city.kawasaki.jp")


def _lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null if there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def normalize_country(raw: Column) -> Column:
    """Name of a country as it is mostly written: cut at ``;``, then ``/``; values that are no alias stay as they are, empty is null."""
    cleaned = F.trim(F.split_part(F.split_part(raw, F.lit(";"), F.lit(1)), F.lit("/"), F.lit(1)))
    return F.when(raw != "", F.coalesce(_lookup(ALIASES, F.lower(cleaned)), cleaned))


def known_country(raw: Column) -> Column:
    """The normalised name if it is a country's, else null."""
    name = normalize_country(raw)
    return F.when(name.isin(*COUNTRIES), name)


def country_region(raw: Column) -> Column:
    return _lookup(REGION_OF, known_country(raw))


def country_continent(raw: Column) -> Column:
    return _lookup(CONTINENT_OF, country_region(raw))


def ending_country(domain: Column) -> Column:
    """Code of the country that a host's last two labels tell, else its last one."""
    parts = F.split(F.concat(F.lit("."), F.lower(F.trim(domain))), r"\.")
    two, one = F.array_join(F.slice(parts, -2, 2), "."), F.element_at(parts, -1)
    return F.when(F.size(parts) > 2, F.coalesce(_lookup(ENDING_OF, two), _lookup(ENDING_OF, one))).otherwise(_lookup(ENDING_OF, one))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def registrable(host: Column, rules: tuple[str, ...] = SUFFIX_RULES) -> Column:
    """Public suffix of a host and one label more; the host itself if it is a suffix or an address.

    All suffixes of the host are looked up at once: exact rules, wildcard rules by what follows the first label, exceptions. The
    longest rule wins, an exception before all, and without any the suffix is the last label.
    """
    exact, wild, out = [r for r in rules if r[0] not in "*!"], [r[2:] for r in rules if r.startswith("*.")], [r[1:] for r in rules if r[0] == "!"]
    none = F.lit(False)

    def of(host: Column, parts: Column) -> Column:
        n = F.size(parts)
        rest = lambda k: F.array_join(F.slice(parts, k, F.greatest(n - k + 1, F.lit(0))), ".")
        places = F.sequence(F.lit(1), n)
        # a place stands for the suffix that begins there
        at_exception = F.filter(places, lambda k: rest(k).isin(*out) if out else none)
        at_rule = F.filter(places, lambda k: (rest(k).isin(*exact) if exact else none) | (((k < n) & rest(k + 1).isin(*wild)) if wild else none))
        start = F.coalesce(F.get(at_exception, F.lit(0)) + 1, F.get(at_rule, F.lit(0)), n)
        address = host.rlike(r"^\d+\.\d+\.\d+\.\d+$")
        return F.when(address | (start == 1), host).otherwise(rest(F.greatest(start - 1, F.lit(1))))

    return _bound(host, lambda h: _bound(F.split(h, r"\."), lambda parts: of(h, parts)))
