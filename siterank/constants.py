"""They define results and must not be changed or re-ordered."""

# Property order used by every report.
PROPERTIES = ("slope", "dust", "surface_temp", "thermal_inertia", "water")

# Site record fields, in record order.
RECORD_FIELDS = (
    "lat", "lon", "elevation", "slope", "roughness", "albedo", "temperature",
    "tempRange", "crustalThickness", "ferric", "pyroxene", "basalt", "lambertAlbedo",
)

# Raster layers (key, name, file, unit, description).
LAYERS = (
    ("elevation", "Elevation (MOLA)", "./public/data/MOLA_128ppd_topo.tif", "m",
     "Mars Orbiter Laser Altimeter elevation data"),
    ("slope", "Slope", "./public/data/mola_hrsc_blend_slope_v2.tif", "°",
     "Surface slope measurements"),
    ("roughness", "Roughness", "./public/data/mola_roughness_0.6km_numeric.tif", "m",
     "Surface roughness at 0.6km scale"),
    ("albedo", "Albedo", "./public/data/omega_albedo_r1080.tif", "",
     "Surface albedo (reflectivity)"),
    ("temperature", "Temperature", "./public/data/mars_yearly_avg_temperature_celsius.tif", "°C",
     "Yearly average surface temperature"),
    ("tempRange", "Temperature Range", "./public/data/mars_yearly_temperature_range_v1.0.tif", "°C",
     "Yearly temperature variation"),
    ("crustalThickness", "Crustal Thickness", "./public/data/mars_crustal_thickness_gmm3_rm1.tif", "km",
     "Mars crustal thickness"),
    ("ferric", "Ferric Content", "./public/data/omega_ferric_nnphs.tif", "",
     "Ferric iron content"),
    ("pyroxene", "Pyroxene", "./public/data/omega_pyroxene_bd2000.tif", "",
     "Pyroxene mineral content"),
    ("basalt", "Basalt", "./public/data/TES_Basalt_numeric.tif", "",
     "Basalt abundance"),
    ("lambertAlbedo", "Lambert Albedo", "./public/data/TES_Lambert_Albedo_numeric.tif", "",
     "Lambert albedo from TES"),
)
LAYER_KEYS = tuple(layer[0] for layer in LAYERS)

# Raster bounds when a layer carries none (west, south, east, north).
DEFAULT_BOUNDS = (-180.0, -90.0, 180.0, 90.0)

# Score weights.
WEIGHTS = {"slope": 0.3, "dust": 0.2, "surface_temp": 0.2, "thermal_inertia": 0.2, "water": 0.1}

# Score ranges (low, high, inverted).
RANGES = {
    "slope": (0.0, 5.0, True),
    "dust": (0.6, 0.7, True),
    "surface_temp": (-90.0, -40.0, False),
    "thermal_inertia": (100.0, 400.0, False),
    "water": (1.0, 8.0, False),
}

# Plausible physical limits (low, high); None is open.
CLAMPS = {
    "slope": (0.0, None),
    "dust": (0.0, 1.0),
    "surface_temp": (None, None),
    "thermal_inertia": (0.0, None),
    "water": (0.0, 8.0),
}

# Measurement defaults when serving.
DEFAULTS = {
    "albedo": 0.2, "temperature": -30.0, "roughness": 50.0, "ferric": 0.5,
    "elevation": 1000.0, "tempRange": 50.0, "slope": 2.0,
}

# Constants used when the regression models are not available.
REGRESSOR_FALLBACK = {"surface_temp": -44.8, "thermal_inertia": 445.2}

# Minimum of the shifted temperature target when none was fitted.
DEFAULT_TEMP_MIN = -100.0

# Score bands as (exclusive upper bound, label), last one open.
BANDS_UI = ((30, "Poor"), (50, "Fair"), (70, "Good"), (None, "Excellent"))
BANDS_DOC = ((30, "Very poor"), (50, "Poor"), (70, "Fair"), (90, "Good"), (None, "Excellent"))

# Serving features per model, as (source, divisor); |x| means absolute value.
FEATURES = {
    "slope": (("albedo", 1.0), ("temperature", 100.0), ("roughness", 1000.0), ("ferric", 1.0),
              ("elevation", 10000.0), ("tempRange", 200.0), ("|slope|", 10.0), ("|slope*0.1|", 10.0)),
    "dust": (("elevation", 10000.0), ("slope", 10.0), ("temperature", 100.0),
             ("temperature", 100.0), ("slope", 10.0), ("albedo", 1.0)),
    "surface_temp": (("elevation", 10000.0), ("albedo", 1.0), ("temperature", 100.0),
                     ("slope", 10.0), ("roughness", 1000.0)),
    "thermal_inertia": (("tempRange", 200.0), ("albedo", 1.0), ("slope", 10.0), ("ferric", 1.0)),
    "water": (("albedo", 1.0), ("temperature", 100.0), ("roughness", 1000.0), ("ferric", 1.0),
              ("elevation", 10000.0), ("tempRange", 200.0), ("|slope|", 10.0), ("|slope*0.1|", 10.0)),
}

# The second feature set; only inertia and water differ. Latitude is 0 there.
FEATURES_FULL = {
    **FEATURES,
    "thermal_inertia": FEATURES["slope"],
    "water": (("elevation", 10000.0), ("lambertAlbedo", 1.0), ("temperature", 100.0),
              ("basalt", 100.0), ("temperature", 100.0), ("latitude", 1.0),
              ("pyroxene", 1.0), ("crustalThickness", 100.0)),
}

# Early stopping (patience, min_delta) per property.
EARLY_STOP = {
    "dust": (30, 1e-8), "slope": (10, 1e-4), "surface_temp": (3, 1e-2),
    "thermal_inertia": (10, 1e-4), "water": (10, 1e-4),
}

# Error texts of responses, which clients match.
LOADING = "Models are still loading. Please try again in a moment."
BAD_BODY = "Invalid JSON in request body"
NOT_JSON = "Request must be JSON"

# Probability below (or above one minus) which the normal transform is clipped.
QUANTILE_EDGE = 1e-7
