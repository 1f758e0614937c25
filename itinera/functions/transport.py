"""Timetable, geography and cost functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itinera import constants as K
from itinera.functions.once import bind


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def station_code(stop_id) -> Column:
    """The eight digits at the end of a stop id, else null."""
    tail = F.substring(_c(stop_id), -8, 8)
    return F.when(tail.rlike("^[0-9]{8}$"), tail)


def clock_to_seconds(clock) -> Column:
    """``HH:MM:SS`` to seconds; hours may exceed 24."""
    part = F.split(F.trim(_c(clock)), ":")
    return (part[0].cast("int") * 3600 + part[1].cast("int") * 60 + part[2].cast("int"))


def city_from_station(name, suffixes=tuple(K.STATION_SUFFIXES), articles=()) -> Column:
    """City part of a station name.

    ``articles`` (for example ``("Le", "La", "Les")``) keeps two words when the
    first one is an article; by default the first word alone is the city (P13).
    """
    def cut(station: Column) -> Column:
        shortened = station
        for suffix in suffixes:
            shortened = F.regexp_replace(shortened, "(?i)" + suffix, "")
        # a cut never changes how the name begins, so one test covers all suffixes
        return F.trim(F.when(station.rlike("(?i)^sainte?"), station).otherwise(shortened))

    def lead(city: Column) -> Column:
        words = F.split(city, r"\s+")
        first = words[0]
        if articles:
            first = F.when(first.isin(list(articles)), F.concat_ws(" ", F.slice(words, 1, 2))) \
                .otherwise(first)
        return F.when(city.contains("-"), city).otherwise(first)

    return bind(bind(F.trim(F.coalesce(_c(name), F.lit(""))), cut), lead)


def service_class(short_name, long_name, rules=tuple(K.SERVICE_CLASS_RULES),
                  default=K.DEFAULT_CLASS) -> Column:
    """Class from two name columns; rules are (class, regex) in priority order."""
    names = F.upper(F.concat(F.coalesce(_c(short_name), F.lit("")), F.lit(" "),
                             F.coalesce(_c(long_name), F.lit(""))))
    out = None
    for label, pattern in rules:
        hit = names.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def routing_cost(minutes, line_code) -> Column:
    """Minutes x multiplier + hop penalty as DECIMAL(18,3) (P10)."""
    code = F.coalesce(_c(line_code), F.lit(K.DEFAULT_CLASS))
    multiplier = penalty = None
    for label, (factor, hop) in K.ROUTING_PARAMS.items():
        m, p = F.lit(factor).cast("decimal(4,2)"), F.lit(hop)
        multiplier = F.when(code == label, m) if multiplier is None else multiplier.when(code == label, m)
        penalty = F.when(code == label, p) if penalty is None else penalty.when(code == label, p)
    factor, hop = K.ROUTING_PARAMS[K.DEFAULT_CLASS]
    multiplier = multiplier.otherwise(F.lit(factor).cast("decimal(4,2)"))
    penalty = penalty.otherwise(F.lit(hop))
    return (_c(minutes).cast("decimal(12,1)") * multiplier + penalty).cast("decimal(18,3)")


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in km."""
    phi1, phi2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_phi = (phi2 - phi1) / 2
    half_lambda = (F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2
    a = F.pow(F.sin(half_phi), F.lit(2)) \
        + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(half_lambda), F.lit(2))
    return F.lit(2 * K.EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def clock_label(minutes) -> Column:
    """``2h05`` from one hour on, else ``45 min``."""
    total = _c(minutes).cast("int")
    hours = F.floor(total / 60).cast("int")
    return F.when(hours > 0, F.format_string("%dh%02d", hours, total % 60)) \
        .otherwise(F.format_string("%d min", total))
