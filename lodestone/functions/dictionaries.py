"""The word lists that normalized names and addresses are defined by."""

# Fixed values. Whole-token expansions in names.
NAME_ABBREVIATIONS = {
    "corp": "corporation", "inc": "incorporated", "ltd": "limited", "pvt": "private", "co": "company",
    "intl": "international", "natl": "national", "mfg": "manufacturing", "svcs": "services", "svc": "service",
    "grp": "group", "assoc": "associates", "assn": "association", "dept": "department", "div": "division",
    "engg": "engineering", "engr": "engineering", "tech": "technology", "techs": "technologies",
    "mgmt": "management", "enterp": "enterprises", "ent": "enterprises", "infra": "infrastructure",
    "soln": "solutions", "solns": "solutions", "sys": "systems", "ind": "industries", "inds": "industries",
    "pharm": "pharmaceuticals", "pharma": "pharmaceuticals", "fin": "financial", "govt": "government",
    "inst": "institute", "univ": "university", "hosp": "hospital", "labs": "laboratories", "lab": "laboratory",
    "bros": "brothers", "bro": "brother",
    "ste": "societe", "ets": "etablissements", "cie": "compagnie",
}

# Fixed values. Legal forms that are no part of a name's core.
LEGAL_SUFFIXES = [
    "private limited", "pvt ltd", "pvt limited", "private ltd", "limited liability partnership",
    "limited liability company", "limited liability", "public limited company", "public limited",
    "limited partnership", "general partnership", "incorporated", "corporation", "limited", "company",
    "llp", "llc", "lp", "plc", "inc", "corp", "ltd", "co",
    "societe a responsabilite limitee", "societe par actions simplifiee", "societe anonyme",
    "entreprise unipersonnelle a responsabilite limitee", "sarl", "sas", "sasu", "sa", "eurl", "sci", "snc", "sca", "scs",
    "gesellschaft mit beschrankter haftung", "gmbh", "ag", "ohg", "kg",
    "opc", "nidhi",
]

# Fixed values. Whole-token expansions in addresses.
ADDRESS_ABBREVIATIONS = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane",
    "ct": "court", "pl": "place", "sq": "square", "pkwy": "parkway", "hwy": "highway", "cir": "circle", "trl": "trail",
    "ter": "terrace", "apt": "apartment", "ste": "suite", "fl": "floor", "bldg": "building", "dept": "department",
    "rm": "room", "po": "post office", "rte": "route",
    "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
    "nagar": "nagar", "marg": "marg", "dist": "district", "opp": "opposite", "nr": "near", "extn": "extension", "ext": "extension",
    "bd": "boulevard", "r": "rue", "ch": "chemin", "imp": "impasse", "all": "allee", "crs": "cours", "fbg": "faubourg",
    "pte": "porte", "pass": "passage", "rsd": "residence", "bat": "batiment", "zac": "zone d amenagement concerte",
    "zi": "zone industrielle", "za": "zone artisanale", "bp": "boite postale", "cs": "cedex",
}

# Fixed values. Tokens that stand for a missing address.
ADDRESS_PLACEHOLDERS = ["null", "none", "nan"]
