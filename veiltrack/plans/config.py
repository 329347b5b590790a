"""Parameters of a de-identification run, and the two file forms that hold them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

#: Keys of the key:value form and the parameters that they set.
FILE_KEYS = {
    "mf_fit_ext": "fit_extension",
    "mf_toggle_scale": "scale_toggle",
    "mf_scale": "fit_scale",
    "n_heading_groups": "heading_groups",
    "min_edge_trip_pts": "min_edge_points",
    "ta_max_q_size": "ta_max_queue",
    "ta_area_width": "ta_area_width",
    "ta_heading_delta": "ta_heading_delta",
    "ta_max_speed": "ta_max_speed",
    "stop_min_distance": "stop_min_distance",
    "stop_max_time": "stop_max_time",
    "stop_max_speed": "stop_max_speed",
    "min_direct_distance": "min_direct",
    "min_manhattan_distance": "min_manhattan",
    "min_out_degree": "min_out_degree",
    "max_direct_distance": "max_direct",
    "max_manhattan_distance": "max_manhattan",
    "max_out_degree": "max_out_degree",
    "rand_direct_distance": "rand_direct",
    "rand_manhattan_distance": "rand_manhattan",
    "rand_out_degree": "rand_out_degree",
    "quad_sw_lat": "sw_lat",
    "quad_sw_lng": "sw_lon",
    "quad_ne_lat": "ne_lat",
    "quad_ne_lng": "ne_lon",
    "plot_kml": "plot_kml",
    "lat_field": "lat_field",
    "lon_field": "lon_field",
    "heading_field": "heading_field",
    "speed_field": "speed_field",
    "time_field": "time_field",
    "uid_fields": "uid_fields",
}
#: Keys of the JSON form.
JSON_KEYS = {
    "kml-output": "plot_kml",
    "lat-field": "lat_field",
    "lng-field": "lon_field",
    "heading-field": "heading_field",
    "speed-field": "speed_field",
    "time-field": "time_field",
    "uid-fields": "uid_fields",
    "fit-ext": "fit_extension",
    "mapfit-scale-toggle": "scale_toggle",
    "mapfit-scale": "fit_scale",
    "heading-groups": "heading_groups",
    "min-edge-trippoints": "min_edge_points",
    "ta-max-q": "ta_max_queue",
    "ta-area-width": "ta_area_width",
    "ta-max-speed": "ta_max_speed",
    "ta-heading-delta": "ta_heading_delta",
    "stop-max-time": "stop_max_time",
    "stop-min-dist": "stop_min_distance",
    "stop-max-speed": "stop_max_speed",
    "min-direct-distance": "min_direct",
    "max-direct-distance": "max_direct",
    "min-manhattan-distance": "min_manhattan",
    "max-manhattan-distance": "max_manhattan",
    "min-out-degree": "min_out_degree",
    "max-out-degree": "max_out_degree",
    "rand-direct-distance": "rand_direct",
    "rand-manhattan-distance": "rand_manhattan",
    "rand-out-degree": "rand_out_degree",
    "sw-lat": "sw_lat",
    "sw-lng": "sw_lon",
    "ne-lat": "ne_lat",
    "ne-lng": "ne_lon",
}
#: Ranges that the JSON form is held to; names are other parameters.
RANGES = {
    "fit_extension": (0.0, None),
    "fit_scale": (1.0, None),
    "heading_groups": (12, None),
    "min_edge_points": (0, None),
    "ta_max_queue": (1, None),
    "ta_area_width": (1.0, None),
    "ta_max_speed": (0.0, None),
    "ta_heading_delta": (45.0, 360.0),
    "stop_max_time": (1, None),
    "stop_min_distance": (1.0, None),
    "stop_max_speed": (0.0, None),
    "min_direct": (0.0, "max_direct"),
    "min_manhattan": (0.0, "max_manhattan"),
    "min_out_degree": (0, "max_out_degree"),
    "max_direct": ("min_direct", None),
    "max_manhattan": ("min_manhattan", None),
    "max_out_degree": ("min_out_degree", None),
    "rand_direct": (0.0, 1.0),
    "rand_manhattan": (0.0, 1.0),
    "rand_out_degree": (0.0, 1.0),
    "sw_lat": (-84.0, "ne_lat"),
    "sw_lon": (-180.0, "ne_lon"),
    "ne_lat": ("sw_lat", 84.0),
    "ne_lon": ("sw_lon", 180.0),
}


@dataclass(frozen=True)
class DIConfig:
    """Defaults are those of the batch tool; INTERACTIVE has those of the interactive one."""

    lat_field: str = "Latitude"
    lon_field: str = "Longitude"
    heading_field: str = "Heading"
    speed_field: str = "Speed"
    time_field: str = "Gentime"
    uid_fields: str = "RxDevice,FileId"
    sw_lat: float = 42.17
    sw_lon: float = -83.91
    ne_lat: float = 42.431
    ne_lon: float = -83.54
    plot_kml: bool = False
    fit_extension: float = 5.0
    scale_toggle: bool = False
    fit_scale: float = 1.0
    heading_groups: int = 36
    min_edge_points: int = 50
    ta_max_queue: int = 20
    ta_area_width: float = 30.0
    ta_max_speed: float = 15.0
    ta_heading_delta: float = 90.0
    stop_max_time: float = 120.0
    stop_min_distance: float = 15.0
    stop_max_speed: float = 3.0
    min_direct: float = 500.0
    max_direct: float = 2500.0
    min_manhattan: float = 650.0
    max_manhattan: float = 3000.0
    min_out_degree: int = 8
    max_out_degree: int = 16
    rand_direct: float = 0.0
    rand_manhattan: float = 0.0
    rand_out_degree: float = 0.0
    error_sample: int = 50
    seed: int = 0

    @property
    def uid_columns(self) -> list[str]:
        return self.uid_fields.split(",")


INTERACTIVE = DIConfig(
    plot_kml=True, fit_extension=0.5, min_edge_points=10, ta_max_speed=100.0, stop_max_time=1.0, stop_min_distance=50.0, stop_max_speed=2.5,
    min_direct=10.0, max_direct=11000.0, min_manhattan=10.0, max_manhattan=11000.0, min_out_degree=0, max_out_degree=10,
    sw_lat=35.946920, sw_lon=-83.938486, ne_lat=35.955526, ne_lon=-83.926738,
)
_TYPES = {f.name: type(f.default) for f in fields(DIConfig)}


def parse_config(text: str, legacy: bool = False) -> DIConfig:
    """From key:value lines.  Unknown keys and values that can't be read are passed over.

    legacy brings back two mistakes that old files may count on: mf_scale sets
    the fit extension, and ta_heading_delta the turnaround width.
    """
    keys = FILE_KEYS | ({"mf_scale": "fit_extension", "ta_heading_delta": "ta_area_width"} if legacy else {})
    found = {}
    for line in text.splitlines():
        key, _, value = line.partition(":")
        name = keys.get(key)
        if name is None:
            continue
        try:
            kind = _TYPES[name]
            found[name] = bool(int(value)) if kind is bool else kind(value.split(":")[0])
        except ValueError:
            continue
    return replace(DIConfig(), **found)


def _checked(name: str, value):
    kind = _TYPES[name]
    if kind is bool:
        return bool(value)
    if kind is str:
        value = str(value)
        if len(value) > 128:
            raise ValueError(f"{name}: over 128 characters")
        if "," in value and name != "uid_fields":
            raise ValueError(f"{name}: has a comma")
        return value
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name}: {value!r} is no number") from None
    if number != number:
        raise ValueError(f"{name}: {value!r} is no number")
    if kind is int and number != int(number):
        raise ValueError(f"{name}: {value!r} is no whole number")
    return kind(number)


def validate(config: DIConfig) -> DIConfig:
    """The config, if all its numbers are in range."""
    for name, (low, high) in RANGES.items():
        value = getattr(config, name)
        for bound, wrong in ((low, lambda v, b: v < b), (high, lambda v, b: v > b)):
            limit = getattr(config, bound) if isinstance(bound, str) else bound
            if limit is not None and wrong(value, limit):
                raise ValueError(f"{name}: {value} is not within {bound}")
    return config


def load_json(text: str, base: DIConfig = INTERACTIVE) -> DIConfig:
    """From JSON over the values of base; types and ranges are checked."""
    given = json.loads(text)
    return validate(replace(base, **{JSON_KEYS[k]: _checked(JSON_KEYS[k], v) for k, v in given.items() if k in JSON_KEYS}))


def dump_json(config: DIConfig) -> str:
    values = asdict(config)
    return json.dumps({k: values[v] for k, v in JSON_KEYS.items()}, indent=2)


def describe(config: DIConfig) -> str:
    """The config in key:value lines, which parse_config reads."""
    values = asdict(config)
    return "".join(f"{k}:{int(values[v]) if isinstance(values[v], bool) else values[v]}\n" for k, v in FILE_KEYS.items())
