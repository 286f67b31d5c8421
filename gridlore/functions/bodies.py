"""Constants of bodies, and ages from crater counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Name, code, semi-axes (km), GM (km3/s2), rotation (hours), body-fixed frame, map projection.
BODIES = [
    ("Mercury", "199", 2439.7, 2439.7, 2438.3, 22032.1, 1407.6, "IAU_MERCURY", "Equirectangular"),
    ("Venus", "299", 6051.8, 6051.8, 6051.8, 324859.0, -5832.6, "IAU_VENUS", "Equirectangular"),
    ("Moon", "301", 1737.4, 1737.4, 1735.0, 4902.8, 655.7, "MOON_ME", "Sinusoidal"),
    ("Mars", "499", 3396.19, 3396.19, 3376.20, 42828.4, 24.62, "IAU_MARS", "Sinusoidal"),
    ("Phobos", "401", 13.0, 11.4, 9.1, 7.158e-4, 7.65, "IAU_PHOBOS", "Stereographic"),
    ("Deimos", "402", 7.8, 6.0, 5.1, 9.615e-5, 30.3, "IAU_DEIMOS", "Stereographic"),
    ("Vesta", "2000004", 278.6, 249.2, 226.2, 17.288, 5.342, "IAU_VESTA", "Sinusoidal"),
    ("Ceres", "2000001", 487.3, 487.3, 454.7, 62.629, 9.074, "IAU_CERES", "Sinusoidal"),
    ("Enceladus", "602", 256.6, 251.4, 248.3, 7.211, 32.9, "IAU_ENCELADUS", "Stereographic"),
    ("Titan", "606", 2574.9, 2574.9, 2574.9, 8978.14, 382.7, "IAU_TITAN", "Equirectangular"),
    ("Pluto", "999", 1188.3, 1188.3, 1188.3, 869.6, -153.3, "IAU_PLUTO", "Stereographic"),
]
#: Fixed values for crater scaling: name, gravity (m/s2), radius (km), bulk and surface density (kg/m3), target type, simple depth ratio, transition diameter (km).
CRATER_BODIES = [
    ("mercury", 3.701, 2439.7, 5427.0, 1800.0, 3, 0.180, 10.3),
    ("venus", 8.870, 6051.8, 5243.0, 2900.0, 3, 0.140, 14.0),
    ("earth", 9.807, 6371.0, 5514.0, 2700.0, 3, 0.130, 3.2),
    ("mars", 3.711, 3389.5, 3933.0, 2900.0, 3, 0.150, 7.0),
    ("moon", 1.622, 1737.4, 3344.0, 1500.0, 2, 0.196, 18.0),
    ("io", 1.796, 1821.6, 3528.0, 2900.0, 3, 0.150, 5.0),
    ("europa", 1.315, 1560.8, 3013.0, 920.0, 1, 0.150, 4.0),
    ("ganymede", 1.428, 2634.1, 1936.0, 920.0, 1, 0.150, 3.5),
    ("callisto", 1.235, 2410.3, 1834.0, 920.0, 1, 0.150, 3.5),
    ("titan", 1.352, 2574.7, 1882.0, 920.0, 1, 0.150, 3.0),
    ("mimas", 0.0648, 198.2, 1148.0, 920.0, 1, 0.150, 0.0),
    ("enceladus", 0.113, 252.1, 1609.0, 920.0, 1, 0.150, 0.0),
    ("tethys", 0.146, 531.0, 984.0, 920.0, 1, 0.150, 0.0),
    ("dione", 0.232, 561.4, 1478.0, 920.0, 1, 0.150, 0.0),
    ("rhea", 0.264, 763.8, 1236.0, 920.0, 1, 0.150, 0.0),
    ("iapetus", 0.223, 734.5, 1088.0, 920.0, 1, 0.150, 0.0),
    ("hyperion", 0.0179, 135.0, 544.0, 700.0, 1, 0.180, 0.0),
    ("phoebe", 0.0394, 106.5, 1638.0, 920.0, 1, 0.150, 0.0),
    ("miranda", 0.079, 235.8, 1200.0, 920.0, 1, 0.150, 0.0),
    ("ariel", 0.249, 578.9, 1592.0, 920.0, 1, 0.150, 0.0),
    ("umbriel", 0.230, 584.7, 1392.0, 920.0, 1, 0.150, 0.0),
    ("titania", 0.371, 788.4, 1711.0, 920.0, 1, 0.150, 0.0),
    ("oberon", 0.346, 761.4, 1630.0, 920.0, 1, 0.150, 0.0),
    ("triton", 0.779, 1353.4, 2061.0, 920.0, 1, 0.150, 0.0),
    ("phobos", 0.0057, 11.27, 1872.0, 1500.0, 2, 0.200, 0.0),
    ("deimos", 0.0030, 6.20, 1471.0, 1500.0, 2, 0.200, 0.0),
    ("pluto", 0.620, 1188.3, 1854.0, 920.0, 1, 0.150, 0.0),
    ("charon", 0.288, 606.0, 1702.0, 920.0, 1, 0.150, 0.0),
    ("ceres", 0.284, 469.7, 2161.0, 1600.0, 2, 0.170, 10.0),
    ("eris", 0.824, 1163.0, 2430.0, 920.0, 1, 0.150, 0.0),
    ("haumea", 0.401, 780.0, 1885.0, 920.0, 1, 0.150, 0.0),
    ("makemake", 0.500, 715.0, 2100.0, 920.0, 1, 0.150, 0.0),
    ("gonggong", 0.220, 615.0, 1740.0, 920.0, 1, 0.150, 0.0),
    ("quaoar", 0.276, 555.0, 2000.0, 920.0, 1, 0.150, 0.0),
    ("sedna", 0.330, 498.0, 2000.0, 920.0, 1, 0.150, 0.0),
    ("orcus", 0.250, 458.0, 1530.0, 920.0, 1, 0.150, 0.0),
    ("salacia", 0.250, 423.0, 1500.0, 920.0, 1, 0.150, 0.0),
    ("vesta", 0.220, 262.7, 3456.0, 2900.0, 3, 0.180, 7.0),
    ("pallas", 0.205, 256.0, 2890.0, 2700.0, 3, 0.200, 0.0),
    ("hygiea", 0.143, 216.5, 1944.0, 2700.0, 3, 0.200, 0.0),
    ("psyche", 0.144, 113.0, 3880.0, 3500.0, 3, 0.200, 0.0),
    ("lutetia", 0.044, 49.0, 3400.0, 2700.0, 3, 0.200, 0.0),
    ("mathilde", 0.010, 26.4, 1300.0, 1300.0, 2, 0.200, 0.0),
    ("eros", 0.006, 8.42, 2670.0, 2700.0, 3, 0.200, 0.0),
    ("itokawa", 0.00009, 0.165, 1900.0, 1900.0, 2, 0.200, 0.0),
    ("bennu", 0.00006, 0.245, 1190.0, 1190.0, 2, 0.200, 0.0),
    ("ryugu", 0.00012, 0.448, 1190.0, 1190.0, 2, 0.200, 0.0),
    ("67p", 0.0001, 2.0, 533.0, 533.0, 2, 0.200, 0.0),
    ("custom", 0.0, 0.0, 0.0, 0.0, 0, 0.196, 0.0),
]
#: Fixed values of the lunar chronology N(>= 1 km) per km2 = a (exp(b t) - 1) + c t, t in Ga.
CHRONOLOGY = (5.44e-14, 6.93, 8.38e-4)


def bodies(spark: SparkSession) -> DataFrame:
    """The table of BODIES with mean_radius and flattening."""
    df = spark.createDataFrame(BODIES, "name string, code string, a double, b double, c double, gm double, rotation_hr double, frame string, projection string")
    return df.withColumn("mean_radius", (F.col("a") + F.col("b") + F.col("c")) / 3).withColumn("flattening", (F.col("a") - F.col("c")) / F.col("a"))


def crater_bodies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CRATER_BODIES, "name string, g double, radius_km double, bulk_density double, surface_density double, target_type int, dd_simple double, dsc_km double")


def chronology(t: Column) -> Column:
    a, b, c = CHRONOLOGY
    return a * (F.exp(b * t) - 1) + c * t


def age_from_density(n1: Column, oldest: float = 4.6, steps: int = 50) -> Column:
    """Ga at which the chronology reaches a density of craters of 1 km or more; halving, as it rises with age; clamped."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(oldest).alias("hi"))

    def halve(x: Column, _: Column) -> Column:
        mid = (x["lo"] + x["hi"]) / 2
        over = chronology(mid) > n1
        return F.struct(F.when(over, x["lo"]).otherwise(mid).alias("lo"), F.when(over, mid).otherwise(x["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda x: (x["lo"] + x["hi"]) / 2)


def age_from_ratio(n1: Column) -> Column:
    """Linear: the observed density over that of one Ga."""
    return n1 / (CHRONOLOGY[0] * (2.718281828459045 ** CHRONOLOGY[1] - 1) + CHRONOLOGY[2])
