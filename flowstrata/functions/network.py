"""Column helpers for addresses, ports and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def is_dotted_quad(ip: Column) -> Column:
    """Four dot-separated parts, whatever they hold."""
    return F.length(ip) - F.length(F.replace(ip, F.lit("."), F.lit(""))) == 3


def source_network(ip: Column) -> Column:
    """The /24 of a dotted quad; any other text unchanged."""
    return F.when(is_dotted_quad(ip), F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))).otherwise(ip)


def normalise_protocol(protocol: Column) -> Column:
    return F.when(F.coalesce(protocol, F.lit("")) == "", F.lit("OTHER")).otherwise(F.upper(protocol))


def _either(src_port: Column, dst_port: Column, test) -> Column:
    return F.coalesce(test(src_port), F.lit(False)) | F.coalesce(test(dst_port), F.lit(False))


def port_category(src_port: Column, dst_port: Column) -> Column:
    """Category of a packet; a null port takes no part in the decision."""
    return (
        F.when(src_port.isNull() & dst_port.isNull(), "unknown")
        .when(_either(src_port, dst_port, lambda p: p.isin(C.OS_NOISE_PORTS)), "os_noise")
        .when(_either(src_port, dst_port, lambda p: p.isin(C.WELL_KNOWN_PORTS)), "well_known")
        .when(_either(src_port, dst_port, lambda p: p >= C.EPHEMERAL_FLOOR), "ephemeral")
        .otherwise("user_app")
    )


def is_private_ipv4(ip: Column) -> Column:
    """10/8, 172.16/12, 192.168/16 or 169.254/16, with every octet in 0..255."""
    text = F.trim(ip)
    octets = [F.split_part(text, F.lit("."), F.lit(i)).try_cast("int") for i in (1, 2, 3, 4)]
    valid = is_dotted_quad(text)
    for octet in octets:
        valid = valid & octet.between(0, 255)
    a, b = octets[0], octets[1]
    private = (
        (a == 10)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
    )
    return F.coalesce(valid & private, F.lit(False))


def mask_ip(ip: Column) -> Column:
    return F.when(is_private_ipv4(ip), F.lit(C.MASKED_IP)).otherwise(ip)


def mask_port(ip: Column, port: Column) -> Column:
    """The port as text, masked where its address is private."""
    return F.when(is_private_ipv4(ip) & port.isNotNull(), F.lit(C.MASKED_PORT)).otherwise(port.cast("string"))


def mask_subnet(subnet: Column) -> Column:
    inside = is_private_ipv4(F.substring_index(subnet, "/", 1))
    return F.when(inside, F.lit(C.MASKED_SUBNET)).otherwise(subnet)


def in_subnet(ip: Column, prefix: str) -> Column:
    """Octet-boundary prefix test; trailing ``.0`` parts of the prefix are wildcards."""
    wanted = prefix.strip().rstrip(".")
    while wanted.endswith(".0"):
        wanted = wanted[:-2]
    if not wanted or wanted.count(".") > 3:
        return F.lit(False)
    return is_dotted_quad(ip) & F.concat(ip, F.lit(".")).startswith(wanted + ".")


def endpoint(ip: Column, port: Column) -> Column:
    return F.concat_ws(":", ip, port.cast("string"))


def human_bytes(size: Column) -> Column:
    value = size.cast("double")

    def shown(power: int, unit: str) -> Column:
        # Halves go to the even digit (95.25 is shown as 95.2); the format alone would round them up.
        return F.format_string(f"%.1f {unit}", F.bround(value / float(1024**power), 1))

    magnitude = F.abs(value)
    out = F.when(magnitude < 1024.0, shown(0, "B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        out = out.when(magnitude < float(1024 ** (power + 1)), shown(power, unit))
    return out.otherwise(shown(4, "TiB"))


def clock_text(ts: Column, zone: str | None = None) -> Column:
    """``HH:MM:SS.mmm``, in the session zone or in a viewer's zone."""
    shown = ts if zone is None else F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))
    return F.date_format(shown, "HH:mm:ss.SSS")


def percent_of(part: Column, whole: Column) -> Column:
    """Share in percent; 0 where the whole is 0 or missing."""
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def service_name(port: Column) -> Column:
    """Display name of a port from the fixed table, empty if unknown.

    The table is a 28-entry literal map, so no join is planned for it.
    """
    table = F.create_map(*[F.lit(x) for pair in C.PORT_SERVICES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, port), F.lit(""))
