"""Areas, dimensions, keyword lists, score maps and palettes."""

from __future__ import annotations

# Fixed values, to be equal to the published indicator definitions.
DIMENSIONS = (
    "INCOME",
    "ACCESS TO HEALTH SERVICES",
    "EDUCATIONAL LAG",
    "ACCESS TO SOCIAL SECURITY",
    "HOUSING",
    "ACCESS TO FOOD",
    "SOCIAL COHESION",
)
OTHER = "OTHER"

TREND_KEYWORDS = {
    "income": ("crisis", "desempleo", "pobreza"),
    "access_to_health_services": ("enfermedad", "centro de salud"),
    "educational_lag": ("becas", "escuela secundaria"),
    "access_to_social_security": ("pensiones", "seguro social"),
    "access_to_food": ("banco de alimentos", "tianguis", "tiendeo", "PromoDescuentos"),
    "housing": ("apoyo Infonavit", "agua potable", "FOVISSSTE"),
    "social_cohesion": ("violencia", "conflictos", "discriminación"),
}

# ISO code of each area and its name.
AREA_CODES = {
    "MX-AGU": "Aguascalientes",
    "MX-BCN": "Baja California",
    "MX-BCS": "Baja California Sur",
    "MX-CAM": "Campeche",
    "MX-CHP": "Chiapas",
    "MX-CHH": "Chihuahua",
    "MX-COA": "Coahuila",
    "MX-COL": "Colima",
    "MX-DUR": "Durango",
    "MX-GUA": "Guanajuato",
    "MX-GRO": "Guerrero",
    "MX-HID": "Hidalgo",
    "MX-JAL": "Jalisco",
    "MX-DIF": "Ciudad de México",
    "MX-MIC": "Michoacán",
    "MX-MOR": "Morelos",
    "MX-NAY": "Nayarit",
    "MX-NLE": "Nuevo León",
    "MX-OAX": "Oaxaca",
    "MX-PUE": "Puebla",
    "MX-QUE": "Querétaro",
    "MX-ROO": "Quintana Roo",
    "MX-SLP": "San Luis Potosí",
    "MX-SIN": "Sinaloa",
    "MX-SON": "Sonora",
    "MX-MEX": "Estado de México",
    "MX-TAB": "Tabasco",
    "MX-TAM": "Tamaulipas",
    "MX-TLA": "Tlaxcala",
    "MX-VER": "Veracruz",
    "MX-YUC": "Yucatán",
    "MX-ZAC": "Zacatecas",
}

# Spellings that name the same area.
AREA_ALIASES = {
    "México": "Estado de México",
    "Mexico": "Estado de México",
    "Estados Unidos Mexicanos": "Estado de México",
    "Michoacán de Ocampo": "Michoacán",
    "Veracruz de Ignacio de la Llave": "Veracruz",
    "Coahuila de Zaragoza": "Coahuila",
    "Yucatan": "Yucatán",
    "Queretaro": "Querétaro",
    "San Luis Potosi": "San Luis Potosí",
    "Nuevo Leon": "Nuevo León",
    "Michoacan": "Michoacán",
}

# Topic column names of the news panel.
NEWS_TOPICS = (
    "economy",
    "women_family",
    "employment",
    "public_services",
    "security",
    "health",
    "breaking_news",
    "politics",
)

# Similarity threshold, shortest text, sentiment of the three classes.
THRESHOLD = 0.10
MIN_CHARS = 10
MIN_WORDS = 10
CLASS_SCORES = (-1, 0, 1)

# Start and end colour per palette; the first pattern found in the parameter name decides.
PALETTES = (
    (("educational", "education"), (144, 238, 144), (0, 100, 0)),
    (("health",), (173, 216, 230), (0, 0, 139)),
    (("social+security",), (255, 182, 193), (139, 0, 0)),
    (("housing",), (221, 160, 221), (75, 0, 130)),
    (("food",), (255, 218, 185), (255, 69, 0)),
    (("income",), (255, 255, 224), (184, 134, 11)),
    (("ext_pov",), (211, 211, 211), (47, 79, 79)),
    (("cohesion",), (255, 192, 203), (199, 21, 133)),
)
DEFAULT_PALETTE = ((144, 238, 144), (0, 100, 0))
RED_GREEN = ((144, 238, 144), (255, 0, 0))

# Official parameter and the predicted one shown beside it.
OFFICIAL_TO_PREDICTED = {
    "value_educational lag": "value_educational_lag_predicted",
    "value_access to health services": "value_health_predicted",
    "value_access to social security": "value_social_security_predicted",
    "value_housing1": "value_housing_predicted",
    "value_housing2": "value_housing_predicted",
    "value_access to food": "value_food_predicted",
    "value_income": "value_income_predicted",
    "value_ext_pov": "value_social_cohesion_predicted",
}

# Model settings of the nowcast.
LASSO_ALPHA = 1.0
FOLDS = 5
PLS_COMPONENTS = 2
FOREST = {"numTrees": 100, "maxDepth": 4, "minInstancesPerNode": 2, "seed": 42}
TOPICS = {"k": 8, "alpha": 0.001, "eta": 0.001, "passes": 20, "seed": 42}

# Function words of the four languages of the test prose; stand-ins for stop-word lists and dimensions.
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "is", "that", "was", "for", "with", "this"),
    "fr": ("les", "des", "une", "dans", "pas"),
    "de": ("und", "nicht", "für", "das"),
    "es": ("que", "los", "para", "con"),
}
DEFAULT_LANGUAGE = "es"
