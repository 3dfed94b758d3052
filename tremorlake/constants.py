"""Grid, heads, reference geography and model constants.

Everything here is data that results depend on; no logic lives in this module.
"""

from __future__ import annotations

# --- fixed values: grid -----------------------------------------------------
LAT_MIN, LAT_MAX = -11.0, 6.0
LON_MIN, LON_MAX = 95.0, 141.0
STEP = 0.5
N_LAT, N_LON = 34, 92
N_CELLS = N_LAT * N_LON
EARTH_RADIUS_KM = 6371.0

# --- fixed values: forecast heads -------------------------------------------
HORIZONS = (7, 14, 30, 60)
THRESHOLDS = (4.5, 5.0, 5.5, 6.0)
DEFAULT_HORIZON, DEFAULT_THRESHOLD = 30, 5.0

# --- fixed values: macro regions (lat_min, lon_min, lat_max, lon_max), epochs
MACRO_BOXES = (
    ("Sumatera", -6.0, 95.0, 6.0, 106.5),
    ("Jawa", -9.0, 105.0, -5.5, 115.0),
    ("BaliNusa", -11.0, 114.0, -8.0, 126.0),
    ("Kalimantan", -4.5, 108.5, 4.5, 119.0),
    ("Sulawesi", -7.5, 118.5, 5.0, 127.0),
    ("MalukuPapua", -11.0, 124.0, 3.0, 141.0),
)
EPOCH_START, EPOCH_END, EPOCH_YEARS = 2000, 2030, 5
DEFAULT_MC = 4.0

# --- fixed values: provinces (name, macro, lat_min, lat_max, lon_min, lon_max)
PROVINCES = (
    ("Aceh", "Sumatera", 2.0, 6.0, 95.0, 98.5),
    ("Sumatera Utara", "Sumatera", 1.0, 4.3, 97.5, 100.5),
    ("Sumatera Barat", "Sumatera", -3.5, 0.5, 99.0, 101.7),
    ("Riau", "Sumatera", -1.0, 2.5, 100.0, 103.5),
    ("Kepulauan Riau", "Sumatera", -1.0, 4.0, 103.0, 109.0),
    ("Jambi", "Sumatera", -3.0, -0.5, 101.0, 104.5),
    ("Bengkulu", "Sumatera", -5.5, -2.0, 101.5, 104.0),
    ("Sumatera Selatan", "Sumatera", -5.0, -1.5, 102.0, 106.0),
    ("Bangka Belitung", "Sumatera", -3.5, -1.0, 105.0, 108.3),
    ("Lampung", "Sumatera", -6.0, -3.5, 103.5, 106.0),
    ("Banten", "Jawa", -7.0, -5.7, 105.0, 106.8),
    ("DKI Jakarta", "Jawa", -6.4, -5.9, 106.5, 107.0),
    ("Jawa Barat", "Jawa", -7.8, -5.9, 106.3, 108.85),
    ("Jawa Tengah", "Jawa", -8.2, -6.0, 108.5, 111.7),
    ("DI Yogyakarta", "Jawa", -8.2, -7.5, 110.0, 110.85),
    ("Jawa Timur", "Jawa", -8.8, -6.5, 110.8, 114.6),
    ("Bali", "BaliNusa", -8.9, -8.0, 114.4, 115.7),
    ("Nusa Tenggara Barat", "BaliNusa", -9.5, -8.0, 115.7, 119.2),
    ("Nusa Tenggara Timur", "BaliNusa", -11.0, -8.0, 118.7, 125.5),
    ("Kalimantan Barat", "Kalimantan", -3.0, 2.5, 108.5, 114.5),
    ("Kalimantan Tengah", "Kalimantan", -4.0, 1.0, 110.5, 115.5),
    ("Kalimantan Selatan", "Kalimantan", -4.5, -1.2, 114.0, 117.0),
    ("Kalimantan Timur", "Kalimantan", -2.5, 4.0, 113.5, 119.0),
    ("Kalimantan Utara", "Kalimantan", 1.0, 4.5, 114.0, 118.0),
    ("Sulawesi Utara", "Sulawesi", 0.0, 5.0, 121.0, 127.0),
    ("Gorontalo", "Sulawesi", 0.0, 1.5, 121.0, 124.0),
    ("Sulawesi Tengah", "Sulawesi", -3.5, 1.5, 119.0, 123.5),
    ("Sulawesi Barat", "Sulawesi", -4.0, -1.0, 118.5, 120.0),
    ("Sulawesi Selatan", "Sulawesi", -7.5, -2.0, 118.5, 122.0),
    ("Sulawesi Tenggara", "Sulawesi", -7.0, -2.0, 120.0, 124.0),
    ("Maluku Utara", "MalukuPapua", -2.5, 3.0, 124.0, 130.0),
    ("Maluku", "MalukuPapua", -8.5, -2.0, 125.0, 135.0),
    ("Papua Barat", "MalukuPapua", -4.5, 0.0, 130.0, 134.5),
    ("Papua", "MalukuPapua", -9.5, -1.0, 134.0, 141.0),
)

# --- fixed values: anchor cities (province, city, lat, lon) -----------------
ANCHORS = (
    ("Aceh", "Banda Aceh", 5.55, 95.32),
    ("Aceh", "Lhokseumawe", 5.18, 97.14),
    ("Aceh", "Meulaboh", 4.14, 96.13),
    ("Sumatera Utara", "Medan", 3.59, 98.67),
    ("Sumatera Utara", "Pematangsiantar", 2.96, 99.06),
    ("Sumatera Utara", "Sibolga", 1.74, 98.78),
    ("Sumatera Barat", "Padang", -0.95, 100.35),
    ("Sumatera Barat", "Bukittinggi", -0.30, 100.37),
    ("Sumatera Barat", "Mentawai", -2.50, 99.50),
    ("Riau", "Pekanbaru", 0.51, 101.45),
    ("Riau", "Dumai", 1.67, 101.45),
    ("Kepulauan Riau", "Tanjung Pinang", 0.92, 104.45),
    ("Kepulauan Riau", "Batam", 1.13, 104.05),
    ("Jambi", "Jambi", -1.61, 103.61),
    ("Bengkulu", "Bengkulu", -3.79, 102.26),
    ("Sumatera Selatan", "Palembang", -2.99, 104.76),
    ("Sumatera Selatan", "Lubuklinggau", -3.30, 102.86),
    ("Bangka Belitung", "Pangkal Pinang", -2.13, 106.11),
    ("Lampung", "Bandar Lampung", -5.43, 105.27),
    ("Banten", "Serang", -6.12, 106.15),
    ("Banten", "Tangerang", -6.18, 106.63),
    ("DKI Jakarta", "Jakarta", -6.20, 106.85),
    ("Jawa Barat", "Bandung", -6.91, 107.61),
    ("Jawa Barat", "Bogor", -6.60, 106.80),
    ("Jawa Barat", "Sukabumi", -6.92, 106.93),
    ("Jawa Tengah", "Semarang", -6.97, 110.42),
    ("Jawa Tengah", "Yogyakarta", -7.80, 110.37),
    ("Jawa Tengah", "Solo", -7.57, 110.83),
    ("DI Yogyakarta", "Yogyakarta", -7.80, 110.37),
    ("Jawa Timur", "Surabaya", -7.25, 112.75),
    ("Jawa Timur", "Malang", -7.98, 112.62),
    ("Jawa Timur", "Banyuwangi", -8.22, 114.37),
    ("Bali", "Denpasar", -8.65, 115.22),
    ("Nusa Tenggara Barat", "Mataram", -8.58, 116.12),
    ("Nusa Tenggara Barat", "Bima", -8.46, 118.73),
    ("Nusa Tenggara Timur", "Kupang", -10.18, 123.61),
    ("Nusa Tenggara Timur", "Maumere", -8.62, 122.21),
    ("Nusa Tenggara Timur", "Ende", -8.85, 121.66),
    ("Kalimantan Barat", "Pontianak", -0.02, 109.34),
    ("Kalimantan Barat", "Singkawang", 0.91, 108.98),
    ("Kalimantan Tengah", "Palangkaraya", -2.21, 113.92),
    ("Kalimantan Selatan", "Banjarmasin", -3.32, 114.59),
    ("Kalimantan Selatan", "Banjarbaru", -3.44, 114.83),
    ("Kalimantan Timur", "Samarinda", -0.50, 117.15),
    ("Kalimantan Timur", "Balikpapan", -1.27, 116.83),
    ("Kalimantan Utara", "Tarakan", 3.30, 117.63),
    ("Kalimantan Utara", "Nunukan", 4.14, 117.66),
    ("Sulawesi Utara", "Manado", 1.49, 124.84),
    ("Sulawesi Utara", "Bitung", 1.45, 125.18),
    ("Gorontalo", "Gorontalo", 0.54, 123.06),
    ("Sulawesi Tengah", "Palu", -0.90, 119.87),
    ("Sulawesi Tengah", "Poso", -1.40, 120.75),
    ("Sulawesi Tengah", "Luwuk", -0.95, 122.79),
    ("Sulawesi Barat", "Mamuju", -2.68, 118.89),
    ("Sulawesi Selatan", "Makassar", -5.13, 119.41),
    ("Sulawesi Selatan", "Parepare", -4.02, 119.62),
    ("Sulawesi Selatan", "Palopo", -3.00, 120.20),
    ("Sulawesi Tenggara", "Kendari", -3.99, 122.51),
    ("Sulawesi Tenggara", "Bau-Bau", -5.47, 122.59),
    ("Maluku Utara", "Ternate", 0.79, 127.37),
    ("Maluku Utara", "Tidore", 0.69, 127.43),
    ("Maluku", "Ambon", -3.65, 128.18),
    ("Maluku", "Tual", -5.64, 132.74),
    ("Papua Barat", "Manokwari", -0.86, 134.06),
    ("Papua Barat", "Sorong", -0.88, 131.25),
    ("Papua", "Jayapura", -2.53, 140.72),
    ("Papua", "Wamena", -4.10, 138.95),
    ("Papua", "Merauke", -8.49, 140.40),
    ("Papua", "Timika", -4.53, 136.88),
)

# --- fixed values: words that place an unknown province in a macro region ----
MACRO_WORDS = (
    ("Sumatera", ("sumat", "aceh", "riau", "lampung", "jambi", "bangka", "bengkulu")),
    ("Jawa", ("jawa", "jakarta", "banten", "yogyakarta")),
    ("BaliNusa", ("bali", "nusa tenggara")),
    ("Kalimantan", ("kalimantan",)),
    ("Sulawesi", ("sulawesi", "gorontalo")),
    ("MalukuPapua", ("maluku", "papua")),
)

# --- fixed values: fault lines (name, type, slip mm/yr, ((lat, lon), ...)) ---
FAULTS = (
    ("Sunda Megathrust (Sumatra segment)", "subduction", 50.0,
     ((5.5, 94.0), (3.0, 95.0), (0.0, 97.5), (-3.0, 100.5), (-5.5, 102.5), (-7.0, 105.5))),
    ("Sunda Megathrust (Java segment)", "subduction", 50.0,
     ((-7.0, 105.5), (-9.0, 109.0), (-10.0, 113.0), (-10.5, 116.0))),
    ("Sunda Megathrust (Bali-Sumba segment)", "subduction", 45.0,
     ((-10.5, 116.0), (-11.0, 119.0), (-11.0, 123.0))),
    ("Sumatra Fault", "transform", 12.0,
     ((5.5, 95.5), (3.0, 97.0), (0.0, 99.5), (-3.0, 102.0), (-5.0, 104.0))),
    ("Palu-Koro Fault", "transform", 35.0, ((-0.5, 119.5), (-1.5, 120.0), (-2.5, 120.5))),
    ("Sorong Fault", "transform", 30.0, ((-1.0, 131.0), (-1.0, 134.0), (-1.0, 136.0))),
    ("Tarera-Aiduna Fault", "transform", 25.0, ((-3.0, 134.0), (-4.0, 136.0), (-4.5, 138.0))),
    ("Banda Sea Subduction", "subduction", 60.0,
     ((-7.0, 124.0), (-7.5, 127.0), (-8.0, 130.0), (-8.5, 132.0))),
    ("North Sulawesi Trench", "subduction", 40.0, ((1.5, 123.0), (1.5, 125.0), (2.0, 127.0))),
    ("Philippine Trench (north Maluku)", "subduction", 50.0, ((1.0, 126.5), (3.0, 127.0), (5.0, 127.5))),
    ("New Guinea Trench (Papua)", "subduction", 40.0, ((-1.5, 137.0), (-1.5, 139.0), (-2.0, 141.0))),
    ("Matano Fault (Sulawesi)", "transform", 30.0, ((-2.5, 121.0), (-2.7, 122.0))),
    ("Lawanopo Fault (Sulawesi)", "transform", 20.0, ((-3.5, 121.5), (-4.0, 122.5))),
    ("Cimandiri Fault (W Java)", "reverse", 4.0, ((-7.0, 106.5), (-7.2, 107.5))),
    ("Lembang Fault (Bandung)", "reverse", 3.0, ((-6.85, 107.5), (-6.85, 107.7))),
    ("Opak Fault (Yogyakarta)", "normal", 2.0, ((-7.7, 110.3), (-8.1, 110.4))),
)
FAULT_TYPE_CODES = (("subduction", 1), ("transform", 2), ("reverse", 3), ("normal", 4))
SLAB_DIP_DEG, SLAB_REACH_KM, SLAB_MAX_KM = 25.0, 500.0, 700.0

# --- fixed values: duplicate limits and source order ------------------------
DEDUP_SECONDS, DEDUP_DEG, DEDUP_MAG = 60, 0.5, 0.5
DEDUP_SOURCE_ORDER = (("usgs", 0), ("emsc", 1), ("bmkg", 2))
CANONICAL_SECONDS, CANONICAL_KM, CANONICAL_MAG = 600, 100.0, 0.5
CANONICAL_SOURCE_SCORE = (("bmkg", 3), ("usgs", 2), ("emsc", 1))
BACKTEST_SECONDS, BACKTEST_KM = 900, 120.0

# --- fixed values: aftershock window ----------------------------------------
TAU_SLOPE, TAU_SHIFT, TAU_MIN_DAYS, TAU_MAX_DAYS = 0.43, -0.06, 1.0, 1825.0
RUPTURE_SLOPE, RUPTURE_SHIFT, RUPTURE_FACTOR = 0.59, -2.44, 10.0

# --- fixed values: features ---------------------------------------------------
ENERGY_SLOPE, ENERGY_SHIFT = 1.5, 4.8
MISSING_FAR = 9999.0
SHORT_WINDOWS_HOURS = (("1h", 1), ("6h", 6), ("24h", 24), ("7d", 168))
SHORT_THRESHOLDS = (("M45", 4.5), ("M50", 5.0))
SHORT_RADII_KM = (100, 300)

# --- fixed values: priors, caps, blends --------------------------------------
EMPTY_CELL_BACKOFF = 0.05
RATE_FLOOR = 1e-7
FALLBACK_ANNUAL, FALLBACK_DECAY = 0.06, 0.43
DEMO_ANNUAL, DEMO_EFOLD_KM, DEMO_MISSING_KM, DEMO_CAP = 0.30, 75.0, 200.0, 0.95
DEMO_FACTORS = (1.5, 1.0, 0.7)  # subduction, transform, other
TECTONIC_ANNUAL = ((4.5, 0.90), (5.0, 0.28), (5.5, 0.08), (6.0, 0.025))
TECTONIC_EFOLD_KM, TECTONIC_MISSING_KM = 90.0, 250.0
TECTONIC_FACTORS = (1.35, 1.05, 0.75)  # subduction, transform, other
TECTONIC_CAP = 0.80
SMOOTH_LONG_WEIGHT = 0.45
CAP_30D = ((4.5, 0.65), (5.0, 0.35), (5.5, 0.16), (6.0, 0.07))
CAP_OVERALL = 0.85
SHRINK_WEIGHTS = (  # threshold, model, recent, smoothed, tectonic
    (4.5, 0.70, 0.10, 0.15, 0.05),
    (5.0, 0.65, 0.10, 0.18, 0.07),
    (5.5, 0.55, 0.10, 0.22, 0.13),
    (6.0, 0.45, 0.10, 0.25, 0.20),
)
BLEND_WEIGHTS = (0.4, 0.4, 0.2)  # first learner, second learner, Poisson
BLEND_ALPHA, BLEND_DEFAULT_EVIDENCE, PROB_FLOOR = 5.0, 10.0, 1e-6
COMPRESS_EPS, COMPRESS_RATIO, COMPRESS_MAX, COMPRESS_MIN_SLOPE = 1e-7, 15.0, 0.50, 0.05
COMPRESS_DEFAULT_RATE = 0.005

# --- fixed values: aftershock point process -----------------------------------
ETAS_MC = 4.5
ETAS_BOUNDS = (("mu", 1e-6, 50.0), ("k", 1e-6, 50.0), ("c", 1e-4, 10.0), ("p", 0.5, 2.5), ("alpha", 0.1, 3.5))
ETAS_START = (("mu", 0.05), ("k", 0.02), ("c", 0.01), ("p", 1.1), ("alpha", 1.5))
ETAS_EMPTY = (("mu", 1e-4), ("k", 1e-4), ("c", 0.01), ("p", 1.1), ("alpha", 1.0))
ETAS_EPS = 1e-12
ETAS_D0, ETAS_GAMMA, ETAS_Q = 2.0, 0.5, 1.5
STUDY_AREA_KM2, CELL_AREA_KM2, EVENT_RATE_CAP = 7.5e6, 2500.0, 0.95
DECAY_REFERENCES = (
    ("Lombok 2018", "2018-08-05 11:46:38", -8.288, 116.452, 6.9),
    ("Palu 2018", "2018-09-28 10:02:45", -0.178, 119.840, 7.5),
    ("Mamuju 2021", "2021-01-14 18:35:49", -2.969, 118.892, 6.2),
)

# --- fixed values: evaluation and alerts --------------------------------------
PRED_FILL, BASELINE_FILL = 0.5, 0.05
TEST_LOW, TEST_HIGH, N_SIMULATIONS = 0.025, 0.975, 1000
BACKTEST_LEADS = (("last_before", 0), ("1h_before", 3600), ("6h_before", 21600),
                  ("24h_before", 86400), ("7d_before", 604800))
ALERT_PROFILES = (  # threshold, n, min_prob, abs_delta, rel_delta
    (5.0, 20, 0.03, 0.005, 0.25),
    (5.5, 20, 0.01, 0.0035, 0.20),
    (6.0, 50, 0.003, 0.0015, 0.20),
)
ALERT_COOLDOWN_MIN = 60
DEBOUNCE_MIN, FALLBACK_HOURS, LOOKBACK_HOURS = 5, 3, 72
ADMIN_ATTEMPTS, ASSIST_ATTEMPTS, ATTEMPT_WINDOW_S = 5, 20, 60
AUDIT_THRESHOLDS = (2.5, 3.0, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0)

# --- fixed values: public text -------------------------------------------------
FORBIDDEN_PHRASES = (
    "pasti terjadi", "akan terjadi gempa", "akan gempa", "segera evakuasi",
    "harus evakuasi", "abaikan bmkg", "aman dari gempa", "tidak akan gempa",
)
REQUIRED_HINTS = ("bukan", "bmkg")
EMPTY_TEXT = "Ringkasan belum tersedia."
BLOCKED_TEXT = "Ringkasan AI diblokir karena mengandung klaim gempa yang terlalu pasti."
TEXT_NOTE = ("\n\nCatatan: ini analisis probabilistik eksperimental, bukan sistem peringatan dini "
             "dan bukan pengganti BMKG/otoritas resmi.")
RISK_BANDS = ((0.001, "rendah"), (0.005, "rendah-sedang"), (0.01, "sedang"), (0.02, "meningkat"))
RISK_TOP, RISK_NONE = "tinggi relatif", "belum ada data"
COLOR_BANDS = ((0.005, "#10b981"), (0.01, "#84cc16"), (0.03, "#f59e0b"), (0.06, "#f97316"))
COLOR_TOP, COLOR_NONE = "#ef4444", "#475569"
PROB_VERY_LOW = 1e-4
SORT_WORDS = (
    ("top3_mean", "rata-rata 3 cell tertinggi"),
    ("max", "cell tertinggi"),
    ("any_cell", "minimal 1 cell"),
    ("mean", "rata-rata seluruh cell"),
)
UNTRACKED_PREFIXES = ("/api/health", "/favicon.ico", "/static/")
