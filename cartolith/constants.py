"""Limits, vocabularies and prices that results depend on."""

from __future__ import annotations

# --- fixed values: earth and map grid ---------------------------------------
MAX_LATITUDE = 85.05112878
EARTH_RADIUS_KM = 6371.0088
EARTH_CIRCUMFERENCE_KM = 40_075.017
EARTH_CIRCUMFERENCE_M = 40_075_016.686
KM_PER_DEGREE_LON = 111.32
KM_PER_DEGREE_LAT = 110.57
METRES_PER_DEGREE = 111_320.0
TILE_PX = 256
MAX_SERVICE_ZOOM = 30
MAX_EVENT_ZOOM = 22

# --- fixed values: geohash ---------------------------------------------------
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
EVENT_PRECISION = 4
SOCIAL_PRECISIONS = (1, 2, 3, 4, 5, 6)
MAX_COVER_CELLS = 128
MAX_LADDER_CELLS = 48

# --- fixed values: events ----------------------------------------------------
KIND_COLLECTION = 30550
KIND_ITEM = 30551
KIND_STATUS = 30315
KIND_FILE = 1063
KIND_MEETUP = 31923
KIND_NOTE = 1
NOTE_KINDS = (1, 1063, 31923)
NOTE_MAX_AGE_S = 48 * 3600
MAX_CREATED_AT = 2147483647
MAX_SAFE_INTEGER = 9007199254740991
PAGE_LIMIT = 500

# --- fixed values: the whitespace code points of the event grammar -------------
PROTOCOL_WHITESPACE = (
    0x0009, 0x000A, 0x000B, 0x000C, 0x000D, 0x001C, 0x001D, 0x001E, 0x001F, 0x0020,
    0x0085, 0x00A0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006,
    0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)

# --- fixed values: collection queue --------------------------------------------
MAX_ATTEMPTS = 4
KIND_PRIORITY = {"dem": 0, "ortho": 1, "features": 2}
MEDIA_TYPES = {
    "dem": "image/png",
    "ortho": "image/jpeg",
    "features": "application/vnd.feature-tile",
}
MAX_RASTER_BYTES = 4_000_000
ELEMENT_CAP = 20_000
MAX_ERROR_CHARS = 500

# --- fixed values: map feature vocabularies -------------------------------------
ROAD_CLASSES = (
    "motorway", "trunk", "primary", "secondary", "tertiary",
    "residential", "service", "track", "path",
)
ROAD_ALIASES = {
    "footway": "path", "pedestrian": "path", "steps": "path", "cycleway": "path",
    "unclassified": "residential", "living_street": "residential",
}
ROAD_WIDTH_M = {
    "motorway": 12.0, "trunk": 10.0, "primary": 8.0, "secondary": 7.0, "tertiary": 6.0,
    "residential": 4.5, "service": 3.0, "track": 2.5, "path": 1.5,
}
WATERWAY_WIDTH_M = {"river": 14.0, "canal": 8.0, "stream": 3.0, "drain": 1.5, "ditch": 1.5}
LANDUSE_CLASSES = (
    "forest", "farmland", "meadow", "grass", "vineyard", "orchard", "scrub", "heath",
    "wetland", "water", "residential", "industrial", "commercial", "quarry", "bare_rock",
)
LANDUSE_TAGS = {
    "forest": "forest", "wood": "forest", "farmland": "farmland", "farmyard": "farmland",
    "orchard": "orchard", "vineyard": "vineyard", "meadow": "meadow", "grass": "grass",
    "grassland": "grass", "village_green": "grass", "scrub": "scrub", "heath": "heath",
    "wetland": "wetland", "marsh": "wetland", "water": "water", "reservoir": "water",
    "basin": "water", "residential": "residential", "industrial": "industrial",
    "commercial": "commercial", "retail": "commercial", "quarry": "quarry",
    "bare_rock": "bare_rock", "scree": "bare_rock",
}
#: Classes that get a ground patch; zones such as residential do not.
LANDCOVER_CLASSES = (
    "forest", "grass", "meadow", "scrub", "heath", "farmland", "orchard", "vineyard",
    "wetland", "water", "bare_rock",
)
DEFAULT_HEIGHT_M = 6.0
METRES_PER_LEVEL = 3.0
MAX_HEIGHT_M = 400.0
MIN_PART_HEIGHT_M = 1.5
MAX_PART_HEIGHT_M = 220.0
TILE_EXTENT = 4096
TILE_MAGIC = 0x54465432
ROAD_LIFT_M = 1.5
LANDCOVER_LIFT_M = 0.25

# --- fixed values: quality gates ------------------------------------------------
IMAGERY_MAX_M_PER_PX = 0.30
IMAGERY_MIN_DETAIL = 1.35
IMAGERY_MIN_BYTES_PER_MP = 120_000.0
SEA_LEVEL_M = 0.5
MAX_NODATA_FRACTION = 0.05
MIN_VALID_ELEVATION_M = -500.0
MAX_VALID_ELEVATION_M = 9_000.0
ELEVATION_MIN_DETAIL = 1.70
MAX_LINEAR_FRACTION = 0.05
MIN_SURFACE_OFFSET_M = 1.0

# --- fixed values: corpus estimate ------------------------------------------------
DEM_TILE_BYTES_Z13 = 43_014
DEM_ANCHOR_LAT = 32.75
ZOOM_TOTAL_SCALE = 3.86
FEATURES_DENSE_BYTES = 139_699
FEATURES_MEAN_FRACTION = (0.02, 0.10)
GATE_BYTES = 40e9

# --- fixed values: delivery plan and price ------------------------------------------
LOD_TIERS = {
    "overview": (11, 12, 2.0),
    "standard": (12, 13, 0.5),
    "detail": (13, 14, 0.25),
}
MAX_AREA_KM2 = 120.0
MAX_DEM_TILES = 64
MAX_FEATURE_TILES = 16
MIN_TEXTURE_M_PER_PX = 0.05
MAX_TEXTURE_M_PER_PX = 10.0
TEXTURE_MAX_TILES = 256
TEXTURE_MAX_SIDE_PX = 4096
RESOLUTION_TOLERANCE = 1e-3
UNIT_PRICE = 21
MIN_PRICE = 1_000
MEGAPIXEL_WEIGHT = 1.0
DEM_TILE_WEIGHT = 8.0
FEATURE_TILE_WEIGHT = 40.0
MESH_TILE_BUDGET = 16
MESH_GRID_N = 192

# --- fixed values: radio windows -----------------------------------------------------
RANGETEST_HEADER = (
    "time,from,sender name,sender lat,sender long,rx lat,rx long,rx elevation,"
    "rx snr,distance,hop limit,payload,rx rssi"
)
SENSITIVITY_DBM = -131
LADDER_STEP_DB = 13

# --- fixed values: regions (west, south, east, north), in declared order --------------
REGIONS = {
    "madeira": (-17.32, 32.35, -16.24, 33.15),
    "south-tyrol": (10.38, 46.21, 12.48, 47.10),
    "vienna": (16.18, 48.11, 16.58, 48.33),
    "europe": (-25.0, 34.0, 32.0, 71.5),
}

# Wording of the elevation disclosure, part of the results.
NOTICE_SOURCE = "Elevation source "
NOTICE_DSM = "a surface model"
NOTICE_MIXED = "a mixed surface/terrain mosaic"
NOTICE_UNKNOWN = (
    " did not report whether it measures bare earth. Buildings, roads and land cover "
    "are placed on it unverified and are indicative only."
)
NOTICE_SURFACE = (
    ", not bare earth: it measures rooftops and canopy. Buildings extruded from it "
    "stand too tall — measured at +5.54 m in built-up areas — and roads and land "
    "cover drape at roof height. Indicative only."
)

# Words and texts of a field sheet, part of the results.
SHEET_WORDS = {
    "leaf_state": ("in-leaf", "bare", "transitional"),
    "precip": ("dry", "wet-foliage", "raining"),
    "wind": ("calm", "moderate", "strong"),
    "pole_foot": ("soil", "rock", "snow", "other"),
}
SHEET_REQUIRED = ("site_id", "operator_id", "date", "node_serial", "antenna_serial", "config_hash")
SHEET_TEXTS = {
    "required": "{} is required",
    "time": "{} is not a valid ISO-8601 time",
    "window": "window_end_utc must be after window_start_utc",
    "station_marks": "station_marks must be a positive integer",
    "pole_mark_m": "pole_mark must be a positive height in metres",
    "antenna_tilt_deg": "antenna_tilt must be between 0 and 90 degrees",
    "gnss_lat": "gnss_lat must be a latitude in decimal degrees",
    "gnss_lon": "gnss_lon must be a longitude in decimal degrees",
    "gnss_acc_m": "gnss_acc_m must be a non-negative distance in metres",
    "gnss_scatter_m": "gnss_scatter_m must be a non-negative distance in metres",
    "word": "{} is not a known value",
    "photo_count": "photos must be a non-negative count",
}
