# Fixed values. Everything below is a domain constant: labels, synonyms, file-name
# patterns and boundaries that the delivered data and the reports are written in.

from __future__ import annotations

# --- fixed values: members of the small dimensions -------------------------------------
LOCAL, NONLOCAL, ETRANGER = "LOCAL", "NONLOCAL", "ETRANGER"
TOURISTE, EXCURSIONNISTE, RESIDENT = "TOURISTE", "EXCURSIONNISTE", "RESIDENT"
CUMUL = "CUMUL"
SENTINELS = ("CUMUL", "NR", "NON RENSEIGNE", "")

# --- fixed values: zone labels, displayed -> stored ------------------------------------
ZONE_TO_BASE = {
    "PAYS D'AURILLAC": "CABA",
    "CANTAL": "CANTAL",
    "CARLADES": "CARLADES",
    "CHÂTAIGNERAIE": "CHÂTAIGNERAIE",
    "CHATAIGNERAIE": "CHÂTAIGNERAIE",
    "HAUT CANTAL": "GENTIANE",
    "HAUT-CANTAL": "GENTIANE",
    "HAUTCANTAL": "GENTIANE",
    "HAUTES TERRES": "HTC",
    "HAUTES-TERRES": "HTC",
    "HAUTESTERRES": "HTC",
    "PAYS DE MAURIAC": "PAYS DE MAURIAC",
    "PAYS SAINT FLOUR": "PAYS SAINT FLOUR",
    "PAYS SALERS": "PAYS SALERS",
    "LIORAN": "STATION",
    "VAL TRUYÈRE": "VAL TRUYÈRE",
    "VAL TRUYERE": "VAL TRUYÈRE",
    "PAYS D�AURILLAC": "CABA",
    "PAYS D AURILLAC": "CABA",
    "PAYS DAURILLAC": "CABA",
    "CH�TAIGNERAIE": "CHÂTAIGNERAIE",
    "VAL TRUY�RE": "VAL TRUYÈRE",
    "CABA": "CABA",
    "GENTIANE": "GENTIANE",
    "HTC": "HTC",
    "STATION": "STATION",
    "CA DU BASSIN D'AURILLAC": "CABA",
    "CC DU CARLADE": "CARLADES",
    "CC DU PAYS DE SALERS": "PAYS SALERS",
    "SAINT FLOUR COMMUNAUTE": "PAYS SAINT FLOUR",
    "ST FLOUR COMMUNAUTE": "PAYS SAINT FLOUR",
    "STATION DE SKI": "STATION",
    "VALLEE DE LA TRUYERE": "VAL TRUYÈRE",
    "HAUTES TERRES COMMUNAUTE": "HAUTES TERRES COMMUNAUTE",
    "STATION THERMALE DE CHAUDES-AIGUES": "STATION THERMALE DE CHAUDES-AIGUES",
    "CC SUMENE ARTENSE": "CC SUMENE ARTENSE",
    "RESTE DEPARTEMENT": "RESTE DEPARTEMENT",
    "CCSA": "CCSA",
}
# fixed values: the same in the production environment, where zones carry their new names
ZONE_TO_BASE_PRODUCTION = {
    "HAUT CANTAL": "HAUT CANTAL",
    "HAUTES TERRES": "HAUTES TERRES",
    "PAYS D'AURILLAC": "PAYS D'AURILLAC",
    "LIORAN": "LIORAN",
    "CANTAL": "CANTAL",
    "CARLADES": "CARLADES",
    "CHÂTAIGNERAIE": "CHÂTAIGNERAIE",
    "CHATAIGNERAIE": "CHÂTAIGNERAIE",
    "PAYS DE MAURIAC": "PAYS DE MAURIAC",
    "PAYS SAINT FLOUR": "PAYS SAINT FLOUR",
    "PAYS SALERS": "PAYS SALERS",
    "VAL TRUYÈRE": "VAL TRUYÈRE",
    "VAL TRUYERE": "VAL TRUYÈRE",
}
# fixed values: zone labels, stored -> displayed
ZONE_TO_DISPLAY = {
    "CABA": "PAYS D'AURILLAC",
    "CANTAL": "CANTAL",
    "CARLADES": "CARLADES",
    "CHÂTAIGNERAIE": "CHÂTAIGNERAIE",
    "GENTIANE": "HAUT CANTAL",
    "HTC": "HAUTES TERRES",
    "PAYS DE MAURIAC": "PAYS DE MAURIAC",
    "PAYS SAINT FLOUR": "PAYS SAINT FLOUR",
    "PAYS SALERS": "PAYS SALERS",
    "STATION": "LIORAN",
    "VAL TRUYÈRE": "VAL TRUYÈRE",
    "CA DU BASSIN D'AURILLAC": "PAYS D'AURILLAC",
    "CC DU CARLADE": "CARLADES",
    "CC DU PAYS DE SALERS": "PAYS SALERS",
    "SAINT FLOUR COMMUNAUTE": "PAYS SAINT FLOUR",
    "ST FLOUR COMMUNAUTE": "PAYS SAINT FLOUR",
    "STATION DE SKI": "LIORAN",
    "VALLEE DE LA TRUYERE": "VAL TRUYÈRE",
    "HAUTES TERRES COMMUNAUTE": "HAUTES TERRES COMMUNAUTE",
    "STATION THERMALE DE CHAUDES-AIGUES": "STATION THERMALE DE CHAUDES-AIGUES",
    "CC SUMENE ARTENSE": "CC SUMENE ARTENSE",
    "RESTE DEPARTEMENT": "RESTE DEPARTEMENT",
    "CCSA": "CCSA",
}
# fixed values: a displayed zone that was stored under several names over the years
ZONE_HISTORY = {
    "HAUTES TERRES": ("HAUTES TERRES", "HAUTES TERRES COMMUNAUTE"),
}
# fixed values: zones never offered in a pick-list
ZONES_HIDDEN = (
    "CA DU BASSIN D'AURILLAC",
    "CC DU CARLADE",
    "CC DU PAYS DE SALERS",
    "SAINT FLOUR COMMUNAUTE",
    "ST FLOUR COMMUNAUTE",
    "STATION DE SKI",
    "VALLEE DE LA TRUYERE",
    "CCSA",
    "CC SUMENE ARTENSE",
    "CANTAL_TEST",
    "HAUTES TERRES COMMUNAUTE",
    "RESTE DEPARTEMENT",
    "STATION THERMALE DE CHAUDES-AIGUES",
)
# fixed values: label pairs a correct alias table must hold
ZONE_EXPECTED = {
    "Pays dAurillac": "CABA",
    "Chataigneraie": "CHÂTAIGNERAIE",
    "Val Truyere": "VAL TRUYÈRE",
    "Haut Cantal": "GENTIANE",
    "Hautes Terres": "HTC",
    "Lioran": "STATION",
}

# --- fixed values: synonyms of members -------------------------------------------------
PROVENANCE_SYNONYMS = {
    "NON LOCAL": NONLOCAL,
    "ÉTRANGER": ETRANGER,
    "STRANGER": ETRANGER,
    "INTERNATIONAL": ETRANGER,
}
CATEGORY_SYNONYMS = {
    "RÉSIDENT": RESIDENT,
}
DEPARTMENT_SYNONYMS = {
    "Z_AUTRE 97": "AUTRE 97",
    "Z_AUTRE 98": "AUTRE 98",
}
COMMUNE_SYNONYMS = {
    "ALBARET STE MARIE": "ALBARET-SAINTE-MARIE",
    "ST MARTIN VALMEROUX": "SAINT-MARTIN-VALMEROUX",
    "AGEN D'AVEYRON": "AGEN-D'AVEYRON",
}
WEEKDAYS_FR = ("LUNDI", "MARDI", "MERCREDI", "JEUDI", "VENDREDI", "SAMEDI", "DIMANCHE")
WEEKDAY_SYNONYMS = {
    "LUN": "LUNDI",
    "MAR": "MARDI",
    "MER": "MERCREDI",
    "JEU": "JEUDI",
    "VEN": "VENDREDI",
    "SAM": "SAMEDI",
    "DIM": "DIMANCHE",
}
MONTHS_FR = (
    "JANVIER", "FÉVRIER", "MARS", "AVRIL", "MAI", "JUIN",
    "JUILLET", "AOÛT", "SEPTEMBRE", "OCTOBRE", "NOVEMBRE", "DÉCEMBRE",
)
TRUE_WORDS = ("1", "true", "yes", "on", "y")
SEGMENT_GROUPS = {
    "PAVILLONNAIRE FAMILIAL AISE": "CSP +",
    "URBAIN FAMILIAL AISE": "CSP +",
    "URBAIN DYNAMIQUE": "CSP +",
    "RURAL DYNAMIQUE": "CSP +",
    "PERIURBAIN EN CROISSANCE": "CSP en croissance",
    "RESIDENCE SECONDAIRE": "CSP en croissance",
    "URBAIN CLASSE MOYENNE": "CSP en croissance",
    "POPULAIRE": "Populaire",
    "RURAL TRADITIONNEL": "Populaire",
    "RURAL OUVRIER": "Populaire",
    "URBAIN DEFAVORISE": "Populaire",
}

# --- fixed values: letters -------------------------------------------------------------
EXTRA_LETTERS = "ÐØðø"
EXTRA_PLAIN = "DOdo"
APOSTROPHES = "’‘´`\x92\x91\x82\x83"
MISREAD_LETTERS = {"\x8a": "S", "\x9a": "s", "\x88": "S", "\x98": "s", "\x86": "S"}
DOUBLE_LETTERS = {"Æ": "AE", "æ": "ae", "\x8c": "OE", "\x9c": "oe"}

# --- fixed values: source columns in order of preference -------------------------------
EPCI_COLUMNS = (
    "EPCIZoneNuiteeSoir", "EPCIZoneDiurneSoir", "EPCIZoneNuiteeVeille",
    "EPCIZoneDiurneVeille", "EPCI", "NomEPCI",
)
INSEE_COLUMNS = (
    "CodeInseeNuiteeSoir", "CodeInseeDiurneSoir", "CodeInseeNuiteeVeille",
    "CodeInseeDiurneVeille", "CodeInsee", "CodeINSEE",
)
COMMUNE_COLUMNS = (
    "ZoneNuiteeSoir", "ZoneDiurneSoir", "ZoneNuiteeVeille", "ZoneDiurneVeille",
    "Zone", "Commune", "NomCommune",
)
DEPARTMENT_COLUMNS = (
    "NomDepartement", "DeptZoneDiurneSoir", "DeptZoneNuiteeSoir",
    "DeptZoneDiurneVeille", "DeptZoneNuiteeVeille", "Departement",
)
GEO_COLUMNS = ("NomRegion", "NomNouvelleRegion", "Pays", "DureeSejour", "DureeSejourNum", "Age", "Geolife")
DELIVERY_COLUMNS = (
    "Date", "VacancesA", "VacancesB", "VacancesC", "Ferie", "JourDeLaSemaine",
    "ZoneObservation", "Provenance", "CategorieVisiteur", "Volume",
)

# --- fixed values: file families -------------------------------------------------------
HISTORY_FAMILIES = (
    "Nuitee", "Diurne",
    "Nuitee_Departement", "Diurne_Departement",
    "Nuitee_Pays", "Diurne_Pays",
    "SejourDuree", "SejourDuree_Departement", "SejourDuree_Pays",
)
MOBILITY_FAMILIES = (
    "LieuActivite_Soir", "LieuActivite_Soir_Departement", "LieuActivite_Soir_Pays",
    "LieuActivite_Veille", "LieuActivite_Veille_Departement", "LieuActivite_Veille_Pays",
    "LieuNuitee_Soir", "LieuNuitee_Soir_Departement", "LieuNuitee_Soir_Pays",
    "LieuNuitee_Veille", "LieuNuitee_Veille_Departement", "LieuNuitee_Veille_Pays",
)
PREFIX_TABLES = {
    "Nuitee_": "fact_nuitees",
    "Diurne_": "fact_diurnes",
    "Nuitee_Departement_": "fact_nuitees_departements",
    "Diurne_Departement_": "fact_diurnes_departements",
    "Nuitee_Pays_": "fact_nuitees_pays",
    "Diurne_Pays_": "fact_diurnes_pays",
    "Nuitee_Age_": "fact_nuitees_age",
    "Diurne_Age_": "fact_diurnes_age",
    "Nuitee_Geolife_": "fact_nuitees_geolife",
    "Diurne_Geolife_": "fact_diurnes_geolife",
}
STAGING_FILES = {
    "frequentation_nuitee.csv": "fact_nuitees_temp",
    "frequentation_journee.csv": "fact_diurnes_temp",
    "frequentation_nuitee_fr.csv": "fact_nuitees_departements_temp",
    "frequentation_journee_fr.csv": "fact_diurnes_departements_temp",
    "frequentation_nuitee_int.csv": "fact_nuitees_pays_temp",
    "frequentation_journee_int.csv": "fact_diurnes_pays_temp",
    "duree_sejour.csv": "fact_sejours_duree_temp",
    "duree_sejour_fr.csv": "fact_sejours_duree_departements_temp",
    "duree_sejour_int.csv": "fact_sejours_duree_pays_temp",
    "export_mobilite.csv": "fact_lieu_activite_soir_temp",
}
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg")
EXCLUDED_PREFIXES = {"Dept_15": "DEPT_15", "TourismeNational_": "TOURISME_NATIONAL"}

# --- fixed values: log patterns, in order of test --------------------------------------
LOG_MARKS = ("❌", "⚠️")
LOG_PATTERNS = (
    ("ZoneObservation.*non trouvé", "Zone inconnue"),
    ("Provenance.*non trouvé", "Provenance inconnue"),
    ("Pays.*non trouvé", "Pays inconnu"),
    ("NomDepartement.*non trouvé", "Département inconnu"),
    ("CategorieVisiteur.*non trouvé", "Catégorie inconnue"),
    ("DureeSejour.*non trouvé", "Durée inconnue"),
    ("Colonne.*manquante", "Colonne manquante"),
    ("fichier introuvable", "Fichier manquant"),
)

# --- fixed values: periods and seasons -------------------------------------------------
PERIOD_CODES = (
    "vacances_hiver", "vacances_paques", "vacances_ete", "vacances_toussaint",
    "vacances_noel", "weekend_paques", "weekend_ascension", "weekend_pentecote",
)
PERIOD_SEASONS = {
    "vacances_hiver": "hiver",
    "vacances_paques": "printemps",
    "vacances_ete": "ete",
    "vacances_toussaint": "automne",
    "vacances_noel": "hiver",
    "weekend_paques": "printemps",
    "weekend_ascension": "printemps",
    "weekend_pentecote": "printemps",
}
SEASON_WORDS = {
    "hiver": "hiver",
    "printemps": "printemps",
    "ete": "ete",
    "été": "ete",
    "automne": "automne",
}
# first and last month of a season; the winter of year N starts in December N-1
SEASON_MONTHS = {"printemps": (3, 5), "ete": (6, 8), "automne": (9, 11), "hiver": (12, 2)}
# astronomical windows as (start MM-dd, end MM-dd); winter ends in the next year
ASTRO_WINDOWS = {
    "printemps": ("03-21", "06-20"),
    "ete": ("06-21", "09-22"),
    "automne": ("09-23", "12-20"),
    "hiver": ("12-21", "03-20"),
}
# used when no period data exists; any other text means the whole year
FALLBACK_WINDOWS = {
    "vacances d'hiver": ("02-08", "03-08"),
    "hiver": ("02-08", "03-08"),
    "week-end de pâques": ("04-08", "04-10"),
    "paques": ("04-08", "04-10"),
    "pont de mai": ("05-01", "06-09"),
    "pont_mai": ("05-01", "06-09"),
    "mai": ("05-01", "06-09"),
    "période printemps": ("04-05", "06-08"),
    "periode printemps": ("04-05", "06-08"),
    "printemps": ("04-05", "06-08"),
}
FULL_YEAR_WORDS = ("annee_complete", "année complète", "annee", "année")
FULL_YEAR_CODE, FULL_YEAR_LABEL = "annee_complete", "Année complète"
STOP_WORDS = ("de", "du", "la", "le", "des", "et", "d")
# word in the request -> further search terms
TERM_EXPANSIONS = (
    ("annee", ("complete",)),
    ("année", ("complete",)),
    ("ete", ("juillet", "aout")),
    ("été", ("juillet", "aout")),
    ("hiver", ("février", "décembre")),
    ("printemps", ("avril", "mai")),
    ("automne", ("septembre", "octobre")),
)
# prefix of a period code -> rank when several periods of a season fit
PERIOD_PREFIX_ORDER = (("vacances_", 1), ("weekend_", 2), ("pont_", 3))

# --- fixed values: thresholds ----------------------------------------------------------
TREND_STEPS = ((20, "forte_croissance"), (5, "croissance"), (-5, "stable"), (-20, "declin"))
SIZE_STEPS = ((10_000, "petites"), (50_000, "moyennes"), (100_000, "grandes"))
EMERGING_MIN, LOSS_MIN = 1_000, 5_000
POISSON_THRESHOLDS = {0.05: 1.96, 0.01: 2.575}
