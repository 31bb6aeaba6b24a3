"""Command line: ``python -m gridloom.cli -i list.txt -o out.tif``."""

from __future__ import annotations

import argparse

from gridloom import api
from gridloom.sources.filelist import read_filelist


def parser() -> argparse.ArgumentParser:
    d = api.DEFAULTS
    p = argparse.ArgumentParser(description="Mosaic many raster files into one.")
    p.add_argument("-i", "--infilelist", required=True, help="text file with one input file a line")
    p.add_argument("-o", "--outfile", required=True)
    p.add_argument("-n", "--numthreads", type=int, default=d["numthreads"])
    p.add_argument("-b", "--blocksize", type=int, default=d["blocksize"])
    p.add_argument("--minoverviewsize", type=int, default=d["minoverviewsize"], help="overviews go on while the longer side is at least this")
    p.add_argument("-d", "--driver", default=d["driver"])
    p.add_argument("--co", action="append", metavar="NAME=VALUE", help="creation option, in place of the driver's defaults; may be repeated")
    p.add_argument("--nullval", type=float, help="nodata value; default: that of the first file")
    p.add_argument("--monitorjson", help="write time spans and parameters of the run here")
    p.add_argument("--outprojepsg", type=int)
    p.add_argument("--outprojwktfile")
    p.add_argument("--xres", type=float)
    p.add_argument("--yres", type=float)
    p.add_argument("--resample", default=d["resamplemethod"])
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    m = api.do_mosaic([x for x in read_filelist(a.infilelist) if x], a.outfile, numthreads=a.numthreads, blocksize=a.blocksize, driver=a.driver, nullval=a.nullval, creationoptions=a.co, outprojepsg=a.outprojepsg,
                      outprojwktfile=a.outprojwktfile, outXres=a.xres, outYres=a.yres, resamplemethod=a.resample, minOverviewSize=a.minoverviewsize)
    if a.monitorjson:
        api.write_report(m, a.monitorjson)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
