"""Places as people write them: countries and cities of free text, and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ventura.functions.places import COUNTRIES, _bound, _lookup, known_country, normalize_country

#: Three-letter codes of countries.
ISO3 = {
    "USA": "United States", "GBR": "United Kingdom", "IND": "India", "JPN": "Japan", "CAN": "Canada", "DEU": "Germany", "CHN": "China",
    "FRA": "France", "SGP": "Singapore", "ARE": "United Arab Emirates", "KOR": "South Korea", "TUR": "Turkey", "ISR": "Israel", "AUS": "Australia",
    "ESP": "Spain", "ITA": "Italy", "NLD": "Netherlands", "CHE": "Switzerland", "SWE": "Sweden", "BRA": "Brazil", "MEX": "Mexico", "RUS": "Russia",
    "POL": "Poland", "IRL": "Ireland", "DNK": "Denmark", "NOR": "Norway", "FIN": "Finland", "BEL": "Belgium", "AUT": "Austria", "PRT": "Portugal",
    "ZAF": "South Africa", "NGA": "Nigeria", "KEN": "Kenya", "EGY": "Egypt", "ARG": "Argentina", "CHL": "Chile", "COL": "Colombia", "IDN": "Indonesia",
    "MYS": "Malaysia", "THA": "Thailand", "VNM": "Vietnam", "PHL": "Philippines", "PAK": "Pakistan", "BGD": "Bangladesh", "LKA": "Sri Lanka", "NZL": "New Zealand",
    "UKR": "Ukraine", "CZE": "Czechia", "ROU": "Romania", "HUN": "Hungary", "GRC": "Greece", "TWN": "Taiwan", "HKG": "Hong Kong", "SAU": "Saudi Arabia",
    "EST": "Estonia", "LTU": "Lithuania", "LVA": "Latvia", "BGR": "Bulgaria", "HRV": "Croatia", "SRB": "Serbia", "SVN": "Slovenia", "SVK": "Slovakia",
    "LUX": "Luxembourg", "ISL": "Iceland", "PER": "Peru", "URY": "Uruguay",
}
#: Codes of countries by the names that close a location.
LOCATION_COUNTRIES = {
    "usa": "US", "us": "US", "united states": "US", "united states of america": "US", "uk": "GB", "united kingdom": "GB", "england": "GB", "scotland": "GB", "wales": "GB",
    "germany": "DE", "deutschland": "DE", "france": "FR", "india": "IN", "china": "CN", "canada": "CA", "japan": "JP", "south korea": "KR", "korea": "KR",
    "australia": "AU", "brazil": "BR", "israel": "IL", "singapore": "SG", "netherlands": "NL", "holland": "NL", "sweden": "SE", "switzerland": "CH", "spain": "ES",
    "italy": "IT", "ireland": "IE", "portugal": "PT", "poland": "PL", "austria": "AT", "belgium": "BE", "norway": "NO", "finland": "FI", "denmark": "DK",
    "czech republic": "CZ", "czechia": "CZ", "new zealand": "NZ", "mexico": "MX", "indonesia": "ID", "thailand": "TH", "vietnam": "VN", "taiwan": "TW", "hong kong": "HK",
    "uae": "AE", "united arab emirates": "AE", "russia": "RU", "turkey": "TR", "ukraine": "UA", "romania": "RO", "argentina": "AR", "colombia": "CO", "chile": "CL",
    "nigeria": "NG", "south africa": "ZA", "kenya": "KE", "egypt": "EG", "pakistan": "PK", "bangladesh": "BD", "philippines": "PH", "malaysia": "MY", "estonia": "EE",
}
#: Those that only the deal database's parser knows.
DEAL_COUNTRIES = {
    "luxembourg": "LU", "hungary": "HU", "greece": "GR", "croatia": "HR", "serbia": "RS", "bulgaria": "BG", "peru": "PE", "saudi arabia": "SA", "qatar": "QA",
    "bahrain": "BH", "kuwait": "KW", "oman": "OM", "sri lanka": "LK", "nepal": "NP", "myanmar": "MM", "cambodia": "KH", "laos": "LA",
}
#: Codes of the states of the US; only the profiles' parser knows the district.
STATES = "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy".split()
DISTRICT = "dc"
#: Cities that tell a country, in order of precedence.
CITIES = {
    "United States": "san francisco|sf|new york|nyc|boston|seattle|austin|chicago|los angeles|palo alto|mountain view|menlo park|cambridge, ma|denver|atlanta|san diego|miami|silicon valley|bay area|brooklyn",
    "United Kingdom": "london|manchester|edinburgh|oxford|bristol",
    "Germany": "berlin|munich|münchen|hamburg|cologne|köln|frankfurt|stuttgart",
    "France": "paris|lyon|toulouse",
    "Netherlands": "amsterdam|rotterdam|utrecht|eindhoven|delft",
    "Spain": "madrid|barcelona|valencia",
    "Italy": "milan|milano|rome|roma|turin",
    "Sweden": "stockholm|gothenburg", "Norway": "oslo", "Denmark": "copenhagen", "Finland": "helsinki", "Iceland": "reykjavik",
    "Switzerland": "zurich|zürich|geneva|lausanne", "Austria": "vienna|wien", "Belgium": "brussels|ghent|leuven", "Portugal": "lisbon|porto", "Ireland": "dublin",
    "Poland": "warsaw|krakow|kraków|wroclaw", "Czech Republic": "prague", "Hungary": "budapest", "Romania": "bucharest", "Greece": "athens", "Bulgaria": "sofia",
    "Croatia": "zagreb", "Slovenia": "ljubljana", "Estonia": "tallinn", "Latvia": "riga", "Lithuania": "vilnius",
    "Israel": "tel aviv|jerusalem|haifa|herzliya",
    "India": "bangalore|bengaluru|mumbai|delhi|new delhi|hyderabad|pune|chennai|gurgaon|noida",
    "South Korea": "seoul|busan|pangyo", "Japan": "tokyo|osaka|kyoto|fukuoka", "China": "beijing|shanghai|shenzhen|hangzhou|guangzhou",
    "Singapore": "singapore", "Hong Kong": "hong kong", "Taiwan": "taipei", "Indonesia": "jakarta", "Thailand": "bangkok", "Malaysia": "kuala lumpur", "Philippines": "manila", "Vietnam": "hanoi|ho chi minh",
    "Australia": "sydney|melbourne|brisbane", "New Zealand": "auckland", "Canada": "toronto|vancouver|montreal|ottawa|waterloo|calgary",
    "Brazil": "são paulo|sao paulo|rio de janeiro", "Argentina": "buenos aires", "Chile": "santiago", "Colombia": "bogota|bogotá", "Mexico": "mexico city", "Peru": "lima",
    "Nigeria": "lagos", "Kenya": "nairobi", "South Africa": "cape town|johannesburg", "Egypt": "cairo", "United Arab Emirates": "dubai|abu dhabi", "Turkey": "istanbul",
    "Russia": "moscow", "Ukraine": "kyiv|kiev", "Belarus": "minsk",
}
CITY_COUNTRY = {city: country for country, listed in CITIES.items() for city in listed.split("|")}
#: Positions of countries and cities.
POSITIONS = {
    "USA": (37.0902, -95.7129), "United States": (37.0902, -95.7129), "US": (37.0902, -95.7129), "Canada": (56.1304, -106.3468), "Mexico": (23.6345, -102.5528),
    "San Francisco": (37.7749, -122.4194), "SF": (37.7749, -122.4194), "New York": (40.7128, -74.0060), "NY": (40.7128, -74.0060), "Los Angeles": (34.0522, -118.2437), "LA": (34.0522, -118.2437),
    "Seattle": (47.6062, -122.3321), "Boston": (42.3601, -71.0589), "Austin": (30.2672, -97.7431), "Chicago": (41.8781, -87.6298), "Miami": (25.7617, -80.1918), "Denver": (39.7392, -104.9903),
    "Portland": (45.5152, -122.6784), "Toronto": (43.6532, -79.3832), "Vancouver": (49.2827, -123.1207), "Montreal": (45.5017, -73.5673),
    "UK": (55.3781, -3.4360), "United Kingdom": (55.3781, -3.4360), "England": (52.3555, -1.1743), "Germany": (51.1657, 10.4515), "France": (46.2276, 2.2137), "Spain": (40.4637, -3.7492),
    "Italy": (41.8719, 12.5674), "Netherlands": (52.1326, 5.2913), "Sweden": (60.1282, 18.6435), "Switzerland": (46.8182, 8.2275), "Austria": (47.5162, 14.5501), "Belgium": (50.5039, 4.4699),
    "Denmark": (56.2639, 9.5018), "Finland": (61.9241, 25.7482), "Norway": (60.4720, 8.4689), "Poland": (51.9194, 19.1451), "Ireland": (53.4129, -8.2439), "Portugal": (39.3999, -8.2245),
    "London": (51.5074, -0.1278), "Berlin": (52.5200, 13.4050), "Paris": (48.8566, 2.3522), "Amsterdam": (52.3676, 4.9041), "Stockholm": (59.3293, 18.0686), "Copenhagen": (55.6761, 12.5683),
    "Madrid": (40.4168, -3.7038), "Barcelona": (41.3851, 2.1734), "Rome": (41.9028, 12.4964), "Milan": (45.4642, 9.1900), "Zurich": (47.3769, 8.5417), "Brussels": (50.8503, 4.3517),
    "Vienna": (48.2082, 16.3738), "Munich": (48.1351, 11.5820), "Dublin": (53.3498, -6.2603), "Lisbon": (38.7223, -9.1393), "Helsinki": (60.1699, 24.9384), "Oslo": (59.9139, 10.7522), "Warsaw": (52.2297, 21.0122),
    "China": (35.8617, 104.1954), "India": (20.5937, 78.9629), "Japan": (36.2048, 138.2529), "South Korea": (35.9078, 127.7669), "Korea": (35.9078, 127.7669), "Singapore": (1.3521, 103.8198),
    "Indonesia": (-0.7893, 113.9213), "Thailand": (15.8700, 100.9925), "Vietnam": (14.0583, 108.2772), "Malaysia": (4.2105, 101.9758), "Philippines": (12.8797, 121.7740), "Taiwan": (23.6978, 120.9605),
    "Hong Kong": (22.3193, 114.1694), "Israel": (31.0461, 34.8516), "UAE": (23.4241, 53.8478),
    "Beijing": (39.9042, 116.4074), "Shanghai": (31.2304, 121.4737), "Shenzhen": (22.5431, 114.0579), "Hangzhou": (30.2741, 120.1551), "Mumbai": (19.0760, 72.8777), "Bangalore": (12.9716, 77.5946),
    "Delhi": (28.7041, 77.1025), "Hyderabad": (17.3850, 78.4867), "Tokyo": (35.6762, 139.6503), "Seoul": (37.5665, 126.9780), "Bangkok": (13.7563, 100.5018), "Ho Chi Minh": (10.8231, 106.6297),
    "Saigon": (10.8231, 106.6297), "Manila": (14.5995, 120.9842), "Jakarta": (6.2088, 106.8456), "Kuala Lumpur": (3.1390, 101.6869), "Tel Aviv": (32.0853, 34.7818), "Dubai": (25.2048, 55.2708), "Abu Dhabi": (24.4539, 54.3773),
    "Australia": (-25.2744, 133.7751), "New Zealand": (-40.9006, 174.8860), "Sydney": (-33.8688, 151.2093), "Melbourne": (-37.8136, 144.9631), "Brisbane": (-27.4698, 153.0251), "Auckland": (-36.8485, 174.7633),
    "Brazil": (-14.2350, -51.9253), "Argentina": (-38.4161, -63.6167), "Chile": (-35.6751, -71.5430), "Colombia": (4.5709, -74.2973), "Peru": (-9.1900, -75.0152),
    "Sao Paulo": (-23.5505, -46.6333), "Buenos Aires": (-34.6037, -58.3816), "Santiago": (-33.4489, -70.6693), "Bogota": (4.7110, -74.0721), "Lima": (-12.0464, -77.0428),
    "South Africa": (-30.5595, 22.9375), "Nigeria": (9.0820, 8.6753), "Kenya": (-0.0236, 37.9062), "Egypt": (26.8206, 30.8025), "Cape Town": (-33.9249, 18.4241), "Lagos": (6.5244, 3.3792), "Nairobi": (-1.2864, 36.8172), "Cairo": (30.0444, 31.2357),
    "Saudi Arabia": (23.8859, 45.0792), "Turkey": (38.9637, 35.2433), "Iran": (32.4279, 53.6880), "Riyadh": (24.7136, 46.6753), "Istanbul": (41.0082, 28.9784), "Ankara": (39.9334, 32.8597),
}
#: Positions of cities of the US, to two decimals.
US_CITIES = {
    "new york": (40.71, -74.01), "nyc": (40.71, -74.01), "los angeles": (34.05, -118.24), "la": (34.05, -118.24), "chicago": (41.88, -87.63), "houston": (29.76, -95.37), "phoenix": (33.45, -112.07),
    "philadelphia": (39.95, -75.17), "san antonio": (29.42, -98.49), "san diego": (32.72, -117.16), "dallas": (32.78, -96.80), "san jose": (37.34, -121.89), "austin": (30.27, -97.74),
    "san francisco": (37.77, -122.42), "sf": (37.77, -122.42), "seattle": (47.61, -122.33), "denver": (39.74, -104.99), "washington": (38.91, -77.04), "washington dc": (38.91, -77.04), "dc": (38.91, -77.04), "washington d.c.": (38.91, -77.04),
    "nashville": (36.16, -86.78), "boston": (42.36, -71.06), "portland": (45.52, -122.68), "las vegas": (36.17, -115.14), "atlanta": (33.75, -84.39), "miami": (25.76, -80.19), "minneapolis": (44.98, -93.27),
    "tampa": (27.95, -82.46), "charlotte": (35.23, -80.84), "raleigh": (35.78, -78.64), "salt lake city": (40.76, -111.89), "pittsburgh": (40.44, -79.99), "st. louis": (38.63, -90.20), "saint louis": (38.63, -90.20),
    "detroit": (42.33, -83.05), "columbus": (39.96, -82.99), "indianapolis": (39.77, -86.16), "kansas city": (39.10, -94.58), "cincinnati": (39.10, -84.51), "cleveland": (41.50, -81.69), "oakland": (37.80, -122.27),
    "palo alto": (37.44, -122.14), "mountain view": (37.39, -122.08), "menlo park": (37.45, -122.18), "cupertino": (37.32, -122.03), "sunnyvale": (37.37, -122.04), "santa clara": (37.35, -121.96), "redwood city": (37.49, -122.24),
    "cambridge": (42.37, -71.11), "boulder": (40.01, -105.27), "ann arbor": (42.28, -83.74), "madison": (43.07, -89.40), "durham": (35.99, -78.90), "irvine": (33.68, -117.83), "santa monica": (34.02, -118.49), "bellevue": (47.61, -122.20),
    "pasadena": (34.15, -118.14), "new haven": (41.31, -72.93), "princeton": (40.36, -74.67), "ithaca": (42.44, -76.50), "provo": (40.23, -111.66), "richmond": (37.54, -77.44), "baltimore": (39.29, -76.61), "sacramento": (38.58, -121.49),
    "orlando": (28.54, -81.38), "omaha": (41.26, -95.93), "tucson": (32.22, -110.97), "albuquerque": (35.08, -106.65), "new orleans": (29.95, -90.07), "chattanooga": (35.05, -85.31), "scottsdale": (33.49, -111.93), "stamford": (41.05, -73.54),
    "arlington": (38.88, -77.10), "plano": (33.02, -96.70), "santa barbara": (34.42, -119.70), "honolulu": (21.31, -157.86), "des moines": (41.59, -93.62), "milwaukee": (43.04, -87.91), "jacksonville": (30.33, -81.66),
}

def _tidy(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _pieces(text: Column, by: str = ",") -> Column:
    return F.transform(F.split(text, by), _tidy)


def clean_country(raw: Column) -> Column:
    """A recognised country: three-letter codes first, then names as ``normalize_country`` writes them; null if it is none."""
    value = _tidy(raw)
    name = normalize_country(value)
    return F.coalesce(_lookup(ISO3, F.upper(value)), F.when(name.isin(*COUNTRIES, *ISO3.values()), name))


def _place(text: Column, names: dict[str, str], us: Column, own_code: Column, last: Column) -> Column:
    """struct(country, city): what stands behind the last comma tells the country, what stands before the first is the city."""
    parts = _pieces(text)
    made = lambda country, city: F.struct(country.cast("string").alias("country"), city.cast("string").alias("city"))
    low, none = F.lower(last), F.lit(None)
    behind = F.when(us, F.lit("US")).otherwise(F.coalesce(_lookup(names, low), F.when(own_code, F.upper(last)), last))
    alone = _lookup(names, F.lower(_tidy(text)))
    return F.when(F.size(parts) > 1, made(behind, F.get(parts, F.lit(0)))).when(alone.isNotNull(), made(alone, none)).otherwise(made(none, _tidy(text)))


def location_of(text: Column) -> Column:
    """struct(country, city) of a location such as ``San Francisco, CA``; both null for no text."""
    last = F.element_at(_pieces(text), -1)
    in_us = F.lower(last).isin(*STATES) | F.replace(F.lower(last), F.lit("."), F.lit("")).isin(*STATES)
    return F.when(text != "", _place(text, LOCATION_COUNTRIES, in_us, F.length(last) == 2, last))


def deal_location_of(text: Column) -> Column:
    """As ``location_of`` for the deal database: no states, more countries, and words for nothing."""
    last = F.element_at(_pieces(text), -1)
    return F.when(~F.lower(text).isin("", "nan", "none"), _place(text, LOCATION_COUNTRIES | DEAL_COUNTRIES, F.lit(False), last.rlike(r"(?U)^\p{L}{2}$"), last))


def _edged(text: Column) -> Column:
    """With a mark at every edge of a word, so that whole words are found by ``contains``."""
    return F.regexp_replace(text, r"(?U)\b", "\u0001")


def _edged_word(words: str) -> str:
    """``_edged`` of words that begin and end with a letter."""
    out, inside = [], False
    for c in words + " ":
        if (c.isalnum() or c == "_") != inside:
            inside = not inside
            out.append("\u0001")
        out.append(c)
    return "".join(out)[:-1]


def country_of(text: Column) -> Column:
    """struct(country, confidence) of a profile's location: .95 for a country's name, .85 for a listed city, .75 for one among other
    words, .8 for a state at the end, .9 for a country at the end, as far as it is known in lower case; null and 0 for anything else.

    Each step is computed once, and only where those before it told nothing: a name that a lambda uses stands for a value, not for its rule.
    """
    cities = F.array(*(F.struct(F.lit(_edged_word(city)).alias("city"), F.lit(country).alias("country")) for city, country in CITY_COUNTRY.items()))
    made = lambda country, sure: F.struct(country.cast("string").alias("country"), F.lit(sure).alias("confidence"))
    first = lambda found: F.get(F.filter(found, lambda c: c.isNotNull()), F.lit(0))
    told = lambda country, sure, rest: _bound(country, lambda c: F.when(c.isNotNull(), made(c, sure)).otherwise(rest()))

    def of(raw: Column, low: Column, parts: Column) -> Column:
        state = F.when((F.size(parts) > 1) & F.element_at(parts, -1).isin(*STATES, DISTRICT), F.lit("United States"))
        among = _bound(_edged(low), lambda edged: F.get(F.filter(cities, lambda c: F.contains(edged, c["city"])), F.lit(0))["country"])
        trailing = lambda: told(first(F.transform(F.reverse(parts), known_country)), 0.9, lambda: made(F.lit(None), 0.0))
        listed = lambda: told(first(F.transform(parts, lambda p: _lookup(CITY_COUNTRY, p))), 0.85, lambda: told(among, 0.75, lambda: told(state, 0.8, trailing)))
        return told(known_country(raw), 0.95, listed)

    pieces = lambda low: F.filter(_pieces(low, "[,/|·•]"), lambda p: p != "")
    raw = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return _bound(raw, lambda raw: _bound(F.lower(raw), lambda low: _bound(pieces(low), lambda parts: of(raw, low, parts))))


def _positions(table: dict[str, tuple[float, float]]) -> Column:
    return F.create_map(*(x for k, (lat, lon) in table.items() for x in (F.lit(k), F.struct(F.lit(lat).alias("latitude"), F.lit(lon).alias("longitude")))))


def position_of(country: Column, city: Column) -> Column:
    """struct(latitude, longitude): as written the city, then the country; then both without regard to case. Null if none is listed."""
    folded: dict[str, tuple[float, float]] = {}
    for name, at in POSITIONS.items():
        folded.setdefault(name.lower(), at)
    exact, loose = _positions(POSITIONS), _positions(folded)
    return F.coalesce(F.try_element_at(exact, city), F.try_element_at(exact, country), F.try_element_at(loose, F.lower(city)), F.try_element_at(loose, F.lower(country)))


def us_position_of(country: Column, city: Column) -> Column:
    """struct(latitude, longitude) of a listed city where the country is the United States as it may be written, else null."""
    return F.when(F.lower(country).rlike("united states|usa|^us$"), F.try_element_at(_positions(US_CITIES), _tidy(F.lower(city))))
