"""Well-known Earth and planetary data sets, by what file names and attributes say."""

from __future__ import annotations

# Key, pattern over lower-case text, resolution.
CATALOG = (
    ("firms", r"firms|modis_c6|viirs_snpp|j1_viirs|active.?fire", "375 m (VIIRS) / 1 km (MODIS) pixels, per overpass"),
    ("power", r"nasa/power|nasa power|power\.larc|-begin header-", "0.5° × 0.625° (MERRA-2) / 1° (CERES) grid cell, not a station"),
    ("mod11", r"m[oy]d11", "1 km, daily (A1) or 8-day (A2)"),
    ("mod13", r"m[oy]d13|modis.{0,20}ndvi|ndvi.{0,20}modis", "250 m-1 km, 16-day composites"),
    ("mcd64", r"mcd64", "500 m, monthly"),
    ("imerg", r"imerg|3b-hhr|3b-day|3b-mo|gpm_3", "0.1°, 30-min / daily / monthly"),
    ("merra2", r"merra-?2|merra2_", "0.5° × 0.625°, hourly to monthly"),
    ("grace", r"grace|grctellus|tellus|mascon|lwe_thickness", "~300 km effective (0.25-1° grids), monthly"),
    ("smap", r"smap|spl[234]", "9-36 km, daily (AM/PM passes)"),
    ("icesat2", r"atl0[0-9]|atl1[0-9]|icesat-?2", "along-track points per beam (gt1l…gt3r)"),
    ("gedi", r"gedi0[12]", "25 m footprints along tracks"),
    ("landsat", r"l[ct]0[89]_|landsat|_sr_b\d|_st_b\d", "30 m, 16-day revisit"),
    ("hls", r"hls\.[ls]30", "30 m, 2-3 day combined revisit"),
    ("oco2", r"oco[23]", "~2 km soundings along track"),
    ("tempo", r"tempo_", "~2 × 4.75 km, hourly daytime, North America"),
    ("nisar", r"nisar", "~10-50 m depending on product"),
    ("viirs_bm", r"vnp46|vj146|black.?marble", "500 m, daily/monthly"),
    ("gistemp", r"gistemp|glb\.ts|ts\+dsst", "global/zonal means, monthly"),
    ("lola", r"(?<![a-z])(lola|ldem|ldsm|lunar.?orbiter.?laser)", "global grids 4-512 pixels/degree; polar DEMs 5-20 m/pixel"),
    ("diviner", r"diviner|(?<![a-z])dlre(?![a-z])", "~200-250 m/pixel maps; polar summer/winter and day/night products"),
    ("lroc", r"lroc|(?<![a-z])(nac|wac)(?![a-z])|lunar.?reconnaissance.?orbiter.?camera|(?<![a-z0-9])m\d{9,10}(le|re|lc|rc|me|ce)(?![a-z0-9])", "NAC ~0.5 m/pixel; WAC ~100 m/pixel"),
    ("mola", r"(?<![a-z])(mola|megdr|mars.?orbiter.?laser)|(?<![a-z0-9])meg[tracs]\d{2}[ns]\d{3}[a-z]{2}", "global grid up to 128 pixels/degree (~463 m)"),
    ("hirise", r"hirise|(?<![a-z])dte[ep][ce]?_|(?<![a-z0-9])(psp|esp|aeb|ptf)_\d{6}_\d{4}", "images 25-50 cm/pixel; DTMs ~1-2 m posting"),
    ("ctx", r"(?<![a-z])ctx(?![a-z])|context.?camera|(?<![a-z0-9])[a-z]\d{2}_\d{6}_\d{4}_x[a-z]_\d{2}[ns]\d{3}w", "~6 m/pixel"),
    ("themis", r"themis", "~100 m/pixel infrared"),
    ("crism", r"crism|(?<![a-z0-9])(frt|hrl|hrs|frs|fft|msp|hsp)[0-9a-f]{8}", "~18-36 m/pixel (targeted), ~100-200 m (mapping)"),
    ("hrsc", r"(?<![a-z])hrsc(?![a-z])|(?<![a-z0-9])h\d{4}_\d{4}_(nd|da|dt|s1|s2|p1|p2|re|gr|bl|ir)", "DTMs ~50-200 m; images ~12.5 m/pixel"),
    ("srtm", r"srtm|nasadem|(?<![a-z])[ns]\d{2}[ew]\d{3}(?![0-9])", "1 arc-second (~30 m) or 3 arc-seconds (~90 m); 60°N-56°S"),
    ("copdem", r"copernicus.?dem|cop.?dem|glo.?30|glo.?90|dem_cop", "~30 m or ~90 m, global"),
    ("aster_gdem", r"aster.?gdem|astgtm", "1 arc-second (~30 m), 83°N-83°S"),
)
# Columns that name a data set by themselves.
COLUMNS = {"firms": ("latitude", "longitude", "frp")}
TOP = 3
