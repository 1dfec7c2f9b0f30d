"""Fixed values of the data model.

Everything here has to equal what published results use, so it is kept as plain
text in one place.
"""

from decimal import Decimal

# Source categories, in presentation order.
FOUR_SOURCES = (
    "marine capture",
    "inland capture",
    "marine aquaculture",
    "inland aquaculture",
)
UNKNOWN = "unknown"
HABITAT_METHODS = (*FOUR_SOURCES, UNKNOWN)

# Origins of a traded product.
DOM_SOURCES = ("domestic", "foreign", "error")

# Product codes that are not food: fishmeal, then ornamental fish.
FISHMEAL_CODE = "230120"
NONFOOD_CODES = ("230120", "030110", "030111", "030119")

# Product-code versions, and which one is authoritative for which years.
HS_VERSIONS = ("HS96", "HS02", "HS07", "HS12", "HS17")
REGIMES = (
    ("HS96", 1996, 2003),
    ("HS02", 2004, 2009),
    ("HS07", 2010, 2012),
    ("HS12", 2013, 2020),
)

# Regions without a meaningful geography are left out of regional tables.
OTHER_REGION = "Other nei"

# Node order of the regional flow diagrams (abbreviated region names).
FLOW_NODE_ORDER = ("Europe", "Oceania", "Asia", "S.America", "N.America", "Africa")

# Smallest flow kept, in tonnes. As a decimal it compares with fixed-point columns
# without converting them, which lets the scan skip rows.
MIN_WEIGHT_T = Decimal("0.1")

# Share of the market whose members are counted.
CONCENTRATION_PERCENT = 75

# Highest plausible supply, kilograms per person and year.
MAX_KG_PER_CAPITA = 100

# The year of the maps and leading species.
SLICE_YEAR = 2019

# First and last years compared, and the divisor of their "annual average". Both
# windows hold five years, yet the published averages divide by the span, four.
BEGINNING_YEARS = (1996, 2000)
END_YEARS = (2016, 2020)
WINDOW_DIVISOR = 4

# Kiribati straddles the antimeridian, so its centroid is given by hand.
CENTROID_OVERRIDES = {"KIR": (172.9717, 1.4518)}

# Least developed countries: name to ISO 3166 alpha-3 code.
LDC_CODE_BY_NAME = {
    "Afghanistan": "AFG",
    "Angola": "AGO",
    "Bangladesh": "BGD",
    "Benin": "BEN",
    "Bhutan": "BTN",
    "Burkina Faso": "BFA",
    "Burundi": "BDI",
    "Cambodia": "KHM",
    "Central African Republic": "CAF",
    "Chad": "TCD",
    "Comoros": "COM",
    "Democratic Republic of the Congo": "COD",
    "Djibouti": "DJI",
    "Eritrea": "ERI",
    "Ethiopia": "ETH",
    "Gambia": "GMB",
    "Guinea": "GIN",
    "Guinea-Bissau": "GNB",
    "Haiti": "HTI",
    "Kiribati": "KIR",
    "Lao People’s Dem. Republic": "LAO",
    "Lesotho": "LSO",
    "Liberia": "LBR",
    "Madagascar": "MDG",
    "Malawi": "MWI",
    "Mali": "MLI",
    "Mauritania": "MRT",
    "Mozambique": "MOZ",
    "Myanmar": "MMR",
    "Nepal": "NPL",
    "Niger": "NER",
    "Rwanda": "RWA",
    "Sao Tome and Principe": "STP",
    "Senegal": "SEN",
    "Sierra Leone": "SLE",
    "Solomon Islands": "SLB",
    "Somalia": "SOM",
    "South Sudan": "SSD",
    "Sudan": "SDN",
    "Timor-Leste": "TLS",
    "Togo": "TGO",
    "Tuvalu": "TUV",
    "Uganda": "UGA",
    "United Republic of Tanzania": "TZA",
    "Yemen": "YEM",
    "Zambia": "ZMB",
}
LDC_CODES = tuple(LDC_CODE_BY_NAME.values())

# Other spellings in use of the same countries.
COUNTRY_ALIASES = {
    "Islamic Republic of Afghanistan": "AFG",
    "Central African Rep.": "CAF",
    "Union of the Comoros": "COM",
    "Comores": "COM",
    "DR Congo": "COD",
    "Congo, Dem. Rep.": "COD",
    "Congo, Democratic Republic of the": "COD",
    "The Gambia": "GMB",
    "Gambia, The": "GMB",
    "Lao PDR": "LAO",
    "Laos": "LAO",
    "Lao People's Democratic Republic": "LAO",
    "Burma": "MMR",
    "Solomon Is.": "SLB",
    "S. Sudan": "SSD",
    "East Timor": "TLS",
    "Democratic Republic of Timor-Leste": "TLS",
    "Tanzania": "TZA",
    "Tanzania, United Rep. of": "TZA",
    "Yemen, Rep.": "YEM",
    "Republic of Yemen": "YEM",
}

# Display names of species on charts, per source category.
SPECIES_LABELS = {
    "marine capture": {
        "alaska pollock(=walleye poll.)": "alaska pollock",
        "ray-finned fishes": "ray finned fishes",
    },
    "marine aquaculture": {},
    "inland capture": {
        "ray-finned fishes": "ray finned fishes",
        "freshwater siluroids": "\nfreshwater siluroids",
        "nile perch": "\nnile perch",
    },
    "inland aquaculture": {
        "ray-finned fishes": "ray finned fishes",
        "striped catfish": "\nstriped catfish",
        "freshwater siluroids": "\nfreshwater siluroids",
        "nile tilapia": "\nnile tilapia",
    },
}
# Categories whose display names also lose the " nei" suffix.
DROP_NEI_SOURCES = ("inland capture", "inland aquaculture")
