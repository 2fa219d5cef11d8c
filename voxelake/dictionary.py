"""Dictionaries of tags, UIDs and private elements.

The seeds hold what imaging queries meet most. `load_tags`, `load_uids` and `load_private` read fuller
ones from any Spark-readable table of the same columns, and `learn_tags` takes one from elements whose
files state their representations. `Dictionary` is the form that parsers carry into the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values (public DICOM PS3.6): tag, VR, VM, keyword.
TAGS = """
00020000|UL|1|FileMetaInformationGroupLength
00020001|OB|1|FileMetaInformationVersion
00020002|UI|1|MediaStorageSOPClassUID
00020003|UI|1|MediaStorageSOPInstanceUID
00020010|UI|1|TransferSyntaxUID
00020012|UI|1|ImplementationClassUID
00020013|SH|1|ImplementationVersionName
00020016|AE|1|SourceApplicationEntityTitle
00080005|CS|1-n|SpecificCharacterSet
00080008|CS|2-n|ImageType
00080012|DA|1|InstanceCreationDate
00080013|TM|1|InstanceCreationTime
00080014|UI|1|InstanceCreatorUID
00080016|UI|1|SOPClassUID
00080018|UI|1|SOPInstanceUID
00080020|DA|1|StudyDate
00080021|DA|1|SeriesDate
00080022|DA|1|AcquisitionDate
00080023|DA|1|ContentDate
0008002A|DT|1|AcquisitionDateTime
00080030|TM|1|StudyTime
00080031|TM|1|SeriesTime
00080032|TM|1|AcquisitionTime
00080033|TM|1|ContentTime
00080050|SH|1|AccessionNumber
00080052|CS|1|QueryRetrieveLevel
00080054|AE|1-n|RetrieveAETitle
00080060|CS|1|Modality
00080061|CS|1-n|ModalitiesInStudy
00080062|UI|1-n|SOPClassesInStudy
00080064|CS|1|ConversionType
00080070|LO|1|Manufacturer
00080080|LO|1|InstitutionName
00080081|ST|1|InstitutionAddress
00080090|PN|1|ReferringPhysicianName
00080100|SH|1|CodeValue
00080102|SH|1|CodingSchemeDesignator
00080103|SH|1|CodingSchemeVersion
00080104|LO|1|CodeMeaning
00080201|SH|1|TimezoneOffsetFromUTC
00081010|SH|1|StationName
00081030|LO|1|StudyDescription
00081032|SQ|1|ProcedureCodeSequence
0008103E|LO|1|SeriesDescription
00081040|LO|1|InstitutionalDepartmentName
00081050|PN|1-n|PerformingPhysicianName
00081060|PN|1-n|NameOfPhysiciansReadingStudy
00081070|PN|1-n|OperatorsName
00081090|LO|1|ManufacturerModelName
00081110|SQ|1|ReferencedStudySequence
00081111|SQ|1|ReferencedPerformedProcedureStepSequence
00081115|SQ|1|ReferencedSeriesSequence
00081140|SQ|1|ReferencedImageSequence
00081150|UI|1|ReferencedSOPClassUID
00081155|UI|1|ReferencedSOPInstanceUID
00081199|SQ|1|ReferencedSOPSequence
00082111|ST|1|DerivationDescription
00082112|SQ|1|SourceImageSequence
00089215|SQ|1|DerivationCodeSequence
00100010|PN|1|PatientName
00100020|LO|1|PatientID
00100021|LO|1|IssuerOfPatientID
00100030|DA|1|PatientBirthDate
00100032|TM|1|PatientBirthTime
00100040|CS|1|PatientSex
00101000|LO|1-n|OtherPatientIDs
00101001|PN|1-n|OtherPatientNames
00101010|AS|1|PatientAge
00101020|DS|1|PatientSize
00101030|DS|1|PatientWeight
00102160|SH|1|EthnicGroup
001021B0|LT|1|AdditionalPatientHistory
00104000|LT|1|PatientComments
00120062|CS|1|PatientIdentityRemoved
00120063|LO|1-n|DeidentificationMethod
00180010|LO|1|ContrastBolusAgent
00180015|CS|1|BodyPartExamined
00180020|CS|1-n|ScanningSequence
00180021|CS|1-n|SequenceVariant
00180022|CS|1-n|ScanOptions
00180023|CS|1|MRAcquisitionType
00180050|DS|1|SliceThickness
00180060|DS|1|KVP
00180080|DS|1|RepetitionTime
00180081|DS|1|EchoTime
00180087|DS|1|MagneticFieldStrength
00180088|DS|1|SpacingBetweenSlices
00181000|LO|1|DeviceSerialNumber
00181020|LO|1-n|SoftwareVersions
00181030|LO|1|ProtocolName
00181100|DS|1|ReconstructionDiameter
00181120|DS|1|GantryDetectorTilt
00181150|IS|1|ExposureTime
00181151|IS|1|XRayTubeCurrent
00181152|IS|1|Exposure
00181164|DS|2|ImagerPixelSpacing
00181200|DA|1-n|DateOfLastCalibration
00181201|TM|1-n|TimeOfLastCalibration
00181210|SH|1-n|ConvolutionKernel
00181310|US|4|AcquisitionMatrix
00181314|DS|1|FlipAngle
00185100|CS|1|PatientPosition
00189089|FD|3|DiffusionGradientOrientation
00189345|FD|1|CTDIvol
00189810|US or SS|1|ZeroVelocityPixelValue
0020000D|UI|1|StudyInstanceUID
0020000E|UI|1|SeriesInstanceUID
00200010|SH|1|StudyID
00200011|IS|1|SeriesNumber
00200012|IS|1|AcquisitionNumber
00200013|IS|1|InstanceNumber
00200020|CS|2|PatientOrientation
00200032|DS|3|ImagePositionPatient
00200037|DS|6|ImageOrientationPatient
00200052|UI|1|FrameOfReferenceUID
00200060|CS|1|Laterality
00201002|IS|1|ImagesInAcquisition
00201041|DS|1|SliceLocation
00204000|LT|1|ImageComments
00209221|SQ|1|DimensionOrganizationSequence
00221452|US or SS|1|MappedPixelValue
00280002|US|1|SamplesPerPixel
00280004|CS|1|PhotometricInterpretation
00280006|US|1|PlanarConfiguration
00280008|IS|1|NumberOfFrames
00280009|AT|1-n|FrameIncrementPointer
00280010|US|1|Rows
00280011|US|1|Columns
00280030|DS|2|PixelSpacing
00280034|IS|2|PixelAspectRatio
00280100|US|1|BitsAllocated
00280101|US|1|BitsStored
00280102|US|1|HighBit
00280103|US|1|PixelRepresentation
00280104|US or SS|1|SmallestValidPixelValue
00280106|US or SS|1|SmallestImagePixelValue
00280107|US or SS|1|LargestImagePixelValue
00280120|US or SS|1|PixelPaddingValue
00280121|US or SS|1|PixelPaddingRangeLimit
00280301|CS|1|BurnedInAnnotation
00281050|DS|1-n|WindowCenter
00281051|DS|1-n|WindowWidth
00281052|DS|1|RescaleIntercept
00281053|DS|1|RescaleSlope
00281054|LO|1|RescaleType
00281055|LO|1-n|WindowCenterWidthExplanation
00281056|CS|1|VOILUTFunction
00281101|US or SS|3|RedPaletteColorLookupTableDescriptor
00281102|US or SS|3|GreenPaletteColorLookupTableDescriptor
00281103|US or SS|3|BluePaletteColorLookupTableDescriptor
00281201|OW|1|RedPaletteColorLookupTableData
00281202|OW|1|GreenPaletteColorLookupTableData
00281203|OW|1|BluePaletteColorLookupTableData
00282000|OB|1|ICCProfile
00282110|CS|1|LossyImageCompression
00282112|DS|1-n|LossyImageCompressionRatio
00283000|SQ|1|ModalityLUTSequence
00283002|US or SS|3|LUTDescriptor
00283003|LO|1|LUTExplanation
00283004|LO|1|ModalityLUTType
00283006|US or OW|1-n|LUTData
00283010|SQ|1|VOILUTSequence
00321060|LO|1|RequestedProcedureDescription
00380010|LO|1|AdmissionID
00400244|DA|1|PerformedProcedureStepStartDate
00400245|TM|1|PerformedProcedureStepStartTime
00400253|SH|1|PerformedProcedureStepID
00400254|LO|1|PerformedProcedureStepDescription
00400275|SQ|1|RequestAttributesSequence
00409096|SQ|1|RealWorldValueMappingSequence
00409211|US or SS|1|RealWorldValueLastValueMapped
00409216|US or SS|1|RealWorldValueFirstValueMapped
0040A010|CS|1|RelationshipType
0040A040|CS|1|ValueType
0040A043|SQ|1|ConceptNameCodeSequence
0040A123|PN|1|PersonName
0040A160|UT|1|TextValue
0040A168|SQ|1|ConceptCodeSequence
0040A30A|DS|1-n|NumericValue
0040A730|SQ|1|ContentSequence
00540016|SQ|1|RadiopharmaceuticalInformationSequence
00880140|UI|1|StorageMediaFileSetUID
20500020|CS|1|PresentationLUTShape
300A00B0|SQ|1|BeamSequence
300A00B2|SH|1|TreatmentMachineName
300A0111|SQ|1|ControlPointSequence
300A011C|DS|2-2n|LeafJawPositions
52009229|SQ|1|SharedFunctionalGroupsSequence
52009230|SQ|1|PerFrameFunctionalGroupsSequence
54000100|SQ|1|WaveformSequence
54001004|US|1|WaveformBitsAllocated
54001010|OB or OW|1|WaveformData
7FE00001|OV|1|ExtendedOffsetTable
7FE00002|OV|1|ExtendedOffsetTableLengths
7FE00008|OF|1|FloatPixelData
7FE00009|OD|1|DoubleFloatPixelData
7FE00010|OB or OW|1|PixelData
"""
#: Fixed values (public DICOM PS3.6): mask tag with x for any digit, VR, keyword.
REPEATERS = (("60xx0010", "US", "OverlayRows"), ("60xx0011", "US", "OverlayColumns"), ("60xx3000", "OB or OW", "OverlayData"), ("50xx3000", "OB or OW", "CurveData"))
#: Creator, masked element, VR, VM, name.
PRIVATE = (("ACUSON", "0009xx00", "IS", "1", "Private data"),)
#: Fixed values (public DICOM PS3.6): UID, name, type, keyword, R where retired.
UIDS = """
1.2.840.10008.1.1|Verification SOP Class|SOP Class|Verification|
1.2.840.10008.1.2|Implicit VR Little Endian|Transfer Syntax|ImplicitVRLittleEndian|
1.2.840.10008.1.2.1|Explicit VR Little Endian|Transfer Syntax|ExplicitVRLittleEndian|
1.2.840.10008.1.2.1.99|Deflated Explicit VR Little Endian|Transfer Syntax|DeflatedExplicitVRLittleEndian|
1.2.840.10008.1.2.2|Explicit VR Big Endian|Transfer Syntax|ExplicitVRBigEndian|R
1.2.840.10008.1.2.4.50|JPEG Baseline (Process 1)|Transfer Syntax|JPEGBaseline8Bit|
1.2.840.10008.1.2.4.51|JPEG Extended (Process 2 & 4)|Transfer Syntax|JPEGExtended12Bit|
1.2.840.10008.1.2.4.57|JPEG Lossless, Non-Hierarchical (Process 14)|Transfer Syntax|JPEGLossless|
1.2.840.10008.1.2.4.70|JPEG Lossless, Non-Hierarchical, First-Order Prediction (Process 14 [Selection Value 1])|Transfer Syntax|JPEGLosslessSV1|
1.2.840.10008.1.2.4.80|JPEG-LS Lossless Image Compression|Transfer Syntax|JPEGLSLossless|
1.2.840.10008.1.2.4.81|JPEG-LS Lossy (Near-Lossless) Image Compression|Transfer Syntax|JPEGLSNearLossless|
1.2.840.10008.1.2.4.90|JPEG 2000 Image Compression (Lossless Only)|Transfer Syntax|JPEG2000Lossless|
1.2.840.10008.1.2.4.91|JPEG 2000 Image Compression|Transfer Syntax|JPEG2000|
1.2.840.10008.1.2.4.92|JPEG 2000 Part 2 Multi-component Image Compression (Lossless Only)|Transfer Syntax|JPEG2000MCLossless|
1.2.840.10008.1.2.4.93|JPEG 2000 Part 2 Multi-component Image Compression|Transfer Syntax|JPEG2000MC|
1.2.840.10008.1.2.4.94|JPIP Referenced|Transfer Syntax|JPIPReferenced|
1.2.840.10008.1.2.4.95|JPIP Referenced Deflate|Transfer Syntax|JPIPReferencedDeflate|
1.2.840.10008.1.2.4.100|MPEG2 Main Profile / Main Level|Transfer Syntax|MPEG2MPML|
1.2.840.10008.1.2.4.101|MPEG2 Main Profile / High Level|Transfer Syntax|MPEG2MPHL|
1.2.840.10008.1.2.4.102|MPEG-4 AVC/H.264 High Profile / Level 4.1|Transfer Syntax|MPEG4HP41|
1.2.840.10008.1.2.4.103|MPEG-4 AVC/H.264 BD-compatible High Profile / Level 4.1|Transfer Syntax|MPEG4HP41BD|
1.2.840.10008.1.2.4.107|HEVC/H.265 Main Profile / Level 5.1|Transfer Syntax|HEVCMP51|
1.2.840.10008.1.2.4.108|HEVC/H.265 Main 10 Profile / Level 5.1|Transfer Syntax|HEVCM10P51|
1.2.840.10008.1.2.4.201|High-Throughput JPEG 2000 Image Compression (Lossless Only)|Transfer Syntax|HTJ2KLossless|
1.2.840.10008.1.2.4.202|High-Throughput JPEG 2000 with RPCL Options Image Compression (Lossless Only)|Transfer Syntax|HTJ2KLosslessRPCL|
1.2.840.10008.1.2.4.203|High-Throughput JPEG 2000 Image Compression|Transfer Syntax|HTJ2K|
1.2.840.10008.1.2.5|RLE Lossless|Transfer Syntax|RLELossless|
1.2.840.10008.1.2.6.1|RFC 2557 MIME encapsulation|Transfer Syntax|RFC2557MIMEEncapsulation|R
1.2.840.10008.1.2.8.1|Deflated Image Frame Compression|Transfer Syntax|DeflatedImageFrameCompression|
1.2.840.10008.1.3.10|Media Storage Directory Storage|SOP Class|MediaStorageDirectoryStorage|
1.2.840.10008.1.20.1|Storage Commitment Push Model SOP Class|SOP Class|StorageCommitmentPushModel|
1.2.840.10008.3.1.1.1|DICOM Application Context Name|Application Context Name|DICOMApplicationContext|
1.2.840.10008.5.1.4.1.1.1|Computed Radiography Image Storage|SOP Class|ComputedRadiographyImageStorage|
1.2.840.10008.5.1.4.1.1.1.1|Digital X-Ray Image Storage - For Presentation|SOP Class|DigitalXRayImageStorageForPresentation|
1.2.840.10008.5.1.4.1.1.1.2|Digital Mammography X-Ray Image Storage - For Presentation|SOP Class|DigitalMammographyXRayImageStorageForPresentation|
1.2.840.10008.5.1.4.1.1.2|CT Image Storage|SOP Class|CTImageStorage|
1.2.840.10008.5.1.4.1.1.2.1|Enhanced CT Image Storage|SOP Class|EnhancedCTImageStorage|
1.2.840.10008.5.1.4.1.1.3.1|Ultrasound Multi-frame Image Storage|SOP Class|UltrasoundMultiFrameImageStorage|
1.2.840.10008.5.1.4.1.1.4|MR Image Storage|SOP Class|MRImageStorage|
1.2.840.10008.5.1.4.1.1.4.1|Enhanced MR Image Storage|SOP Class|EnhancedMRImageStorage|
1.2.840.10008.5.1.4.1.1.6.1|Ultrasound Image Storage|SOP Class|UltrasoundImageStorage|
1.2.840.10008.5.1.4.1.1.7|Secondary Capture Image Storage|SOP Class|SecondaryCaptureImageStorage|
1.2.840.10008.5.1.4.1.1.9.1.1|12-lead ECG Waveform Storage|SOP Class|TwelveLeadECGWaveformStorage|
1.2.840.10008.5.1.4.1.1.11.1|Grayscale Softcopy Presentation State Storage|SOP Class|GrayscaleSoftcopyPresentationStateStorage|
1.2.840.10008.5.1.4.1.1.12.1|X-Ray Angiographic Image Storage|SOP Class|XRayAngiographicImageStorage|
1.2.840.10008.5.1.4.1.1.20|Nuclear Medicine Image Storage|SOP Class|NuclearMedicineImageStorage|
1.2.840.10008.5.1.4.1.1.66.4|Segmentation Storage|SOP Class|SegmentationStorage|
1.2.840.10008.5.1.4.1.1.88.11|Basic Text SR Storage|SOP Class|BasicTextSRStorage|
1.2.840.10008.5.1.4.1.1.88.22|Enhanced SR Storage|SOP Class|EnhancedSRStorage|
1.2.840.10008.5.1.4.1.1.88.33|Comprehensive SR Storage|SOP Class|ComprehensiveSRStorage|
1.2.840.10008.5.1.4.1.1.104.1|Encapsulated PDF Storage|SOP Class|EncapsulatedPDFStorage|
1.2.840.10008.5.1.4.1.1.128|Positron Emission Tomography Image Storage|SOP Class|PositronEmissionTomographyImageStorage|
1.2.840.10008.5.1.4.1.1.481.1|RT Image Storage|SOP Class|RTImageStorage|
1.2.840.10008.5.1.4.1.1.481.2|RT Dose Storage|SOP Class|RTDoseStorage|
1.2.840.10008.5.1.4.1.1.481.3|RT Structure Set Storage|SOP Class|RTStructureSetStorage|
1.2.840.10008.5.1.4.1.1.481.5|RT Plan Storage|SOP Class|RTPlanStorage|
"""
NATIVE = ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2")
TAG_COLUMNS, UID_COLUMNS, PRIVATE_COLUMNS = ("tag", "vr", "vm", "keyword"), ("uid", "name", "type", "keyword", "retired"), ("creator", "masked", "vr", "vm", "name")


def tag_rows() -> list[tuple[int, str, str, str]]:
    """(tag, vr, vm, keyword) of the seed."""
    return [(int(t, 16), vr, vm, k) for t, vr, vm, k in (line.split("|") for line in TAGS.split("\n") if line)]


def uid_rows() -> list[tuple[str, str, str, str, bool]]:
    """(uid, name, type, keyword, retired) of the seed."""
    return [(u, n, t, k, r == "R") for u, n, t, k, r in (line.split("|") for line in UIDS.split("\n") if line)]


def mask_of(text: str) -> tuple[int, int]:
    """(value, mask) of a tag with x for any digit: a tag belongs to it if tag & mask = value."""
    return int(text.replace("x", "0"), 16), int("".join("0" if c == "x" else "F" for c in text), 16)


TRANSFER_SYNTAXES = {u: n for u, n, t, _, _ in uid_rows() if t == "Transfer Syntax"}


@dataclass
class Dictionary:
    """What a parser asks: representations by tag, repeating groups, and by private creator."""

    tags: dict[int, tuple[str, str]] = field(default_factory=lambda: {t: (vr, k) for t, vr, _, k in tag_rows()})
    repeaters: list[tuple[int, int, str, str]] = field(default_factory=lambda: [(*mask_of(m), vr, k) for m, vr, k in REPEATERS])
    private: dict[tuple[str, str], str] = field(default_factory=lambda: {(c, m): vr for c, m, vr, _, _ in PRIVATE})

    def repeater(self, tag: int) -> tuple[str, str] | None:
        """(vr, keyword) of the repeating group that a tag belongs to."""
        return next(((vr, k) for value, mask, vr, k in self.repeaters if tag & mask == value), None)

    def vr(self, tag: int, creator: str | None = None) -> str:
        """Exact tag, group length, LO for creators, private element by creator, repeating group, else UN."""
        if tag in self.tags:
            return self.tags[tag][0]
        group, element = tag >> 16, tag & 0xFFFF
        if element == 0:
            return "UL"
        if group & 1:
            if 0x10 <= element <= 0xFF:
                return "LO"
            g, e = f"{group:04X}", f"{element:04X}"
            return next((self.private[creator, m] for m in (g + e, f"{g}xx{e[2:]}", f"{g[:2]}xxxx{e[2:]}") if (creator, m) in self.private), "UN")
        return (self.repeater(tag) or ("UN",))[0]

    def keyword(self, tag: int) -> str:
        """The keyword of a tag; empty where it has none."""
        return (self.tags.get(tag) or (None, (self.repeater(tag) or ("", ""))[1]))[1]

    def tag(self, keyword: str) -> int:
        """The tag of a keyword; an error for unknown ones."""
        found = self.by_keyword().get(keyword)
        if found is None:
            raise ValueError(f"no tag has the keyword {keyword}")
        return found

    def by_keyword(self) -> dict[str, int]:
        return {k: t for t, (_, k) in self.tags.items()}

    def extended(self, tags: Iterable[tuple] = (), private: Iterable[tuple] = (), repeaters: Iterable[tuple] = ()) -> Dictionary:
        """With more entries, which go before those there: tags as (tag, vr, vm, keyword), private ones
        as (creator, masked, vr, vm, name) of odd groups, repeaters as (mask, vr, keyword)."""
        more = list(private)
        for _, m, *_ in more:
            _private_group(m)
        return Dictionary(
            {**self.tags, **{t: (vr, k) for t, vr, _, k in tags}}, [*((*mask_of(m), vr, k) for m, vr, k in repeaters), *self.repeaters],
            {**self.private, **{(c, m): vr for c, m, vr, _, _ in more}},
        )


SEED = Dictionary()
VR_OF = {t: vr for t, (vr, _) in SEED.tags.items()}
TAG_OF = SEED.by_keyword()


def _private_group(masked: str) -> None:
    if len(masked) != 8 or masked[3] != "x" and int(masked[3], 16) % 2 == 0:
        raise ValueError(f"{masked} is no private group")


def lookup_vr(tag: int, creator: str | None = None) -> str:
    """The VR of a tag by the seed."""
    return SEED.vr(tag, creator)


def parse_tag(text: str, dictionary: Dictionary = SEED) -> int:
    """A tag from (GGGG,EEEE), GGGG,EEEE, up to eight hex digits or a keyword."""
    t = text.strip().strip("()").replace(" ", "")
    pair = t.split(",")
    try:
        return int(pair[0], 16) << 16 | int(pair[1], 16) if len(pair) == 2 and all(len(p) == 4 for p in pair) else int(t, 16) if len(t) <= 8 else dictionary.tag(t)
    except ValueError:
        return dictionary.tag(t)


def dict_tags(spark: SparkSession) -> DataFrame:
    """The seed of tags as a DataFrame (under 200 rows)."""
    return spark.createDataFrame(tag_rows(), "tag bigint, vr string, vm string, keyword string")


def dict_repeaters(spark: SparkSession) -> DataFrame:
    """Repeating groups as value and mask."""
    return spark.createDataFrame([(*mask_of(m), vr, k) for m, vr, k in REPEATERS], "value bigint, mask bigint, vr string, keyword string")


def dict_private(spark: SparkSession, extra: list[tuple[str, str, str, str, str]] = ()) -> DataFrame:
    """Private elements by creator and masked element; `extra` rows add to the seed."""
    for _, m, *_ in extra:
        _private_group(m)
    return spark.createDataFrame([*PRIVATE, *extra], "creator string, masked string, vr string, vm string, name string")


def dict_uids(spark: SparkSession, table: DataFrame | None = None) -> DataFrame:
    """UIDs (those of `table`, else the seed) with the properties of transfer syntaxes; null for others."""
    u = spark.createDataFrame(uid_rows(), "uid string, name string, type string, keyword string, retired boolean") if table is None else table
    uid, syntax = F.col("uid"), F.col("type") == "Transfer Syntax"
    flag = lambda c: F.when(syntax, c)
    return u.select(
        *UID_COLUMNS,
        flag(uid == NATIVE[0]).alias("implicit_vr"), flag(uid != NATIVE[3]).alias("little_endian"), flag(uid == NATIVE[2]).alias("deflated"), flag(~uid.isin(*NATIVE)).alias("encapsulated"),
    )


def _columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"the dictionary lacks the columns {missing}")
    return df.select(*names)


def load_tags(source: DataFrame) -> DataFrame:
    """A tag dictionary (tag as a number or eight hex digits, vr, vm, keyword) from any table."""
    df = _columns(source, TAG_COLUMNS)
    tag = F.conv("tag", 16, 10) if df.schema["tag"].dataType.simpleString() == "string" else F.col("tag")
    return df.withColumn("tag", tag.cast("bigint")).where("tag IS NOT NULL AND vr IS NOT NULL")


def load_uids(source: DataFrame) -> DataFrame:
    """A UID dictionary (uid, name, type, keyword, retired) from any table."""
    return _columns(source, UID_COLUMNS).where("uid IS NOT NULL").withColumn("retired", F.coalesce(F.col("retired").cast("boolean"), F.lit(False)))


def load_private(source: DataFrame) -> DataFrame:
    """A private dictionary (creator, masked element, vr, vm, name) from any table."""
    return _columns(source, PRIVATE_COLUMNS).where("creator IS NOT NULL AND masked IS NOT NULL")


def learn_tags(elements: DataFrame) -> DataFrame:
    """A tag dictionary from elements of explicit files: each public tag with its most frequent VR."""
    known = elements.where("vr IS NOT NULL AND vr <> 'UN' AND shiftright(tag, 16) % 2 = 0").groupBy("tag", "vr").agg(F.count("*").alias("n"))
    return known.groupBy("tag").agg(F.max_by("vr", F.struct("n", "vr")).alias("vr")).select("tag", "vr", F.lit("1-n").alias("vm"), F.lit("").alias("keyword"))


#: Entries of a dictionary that may come to the driver; the published ones have some 5,000 and 10,000.
MOST_ENTRIES = 50_000


def dictionary_of(tags: DataFrame | None = None, private: DataFrame | None = None) -> Dictionary:
    """The seed extended by dictionary tables, for parsers. An error for more than MOST_ENTRIES rows."""

    def rows(df: DataFrame | None, names: tuple[str, ...]) -> list[tuple]:
        got = [] if df is None else df.select(*names).limit(MOST_ENTRIES + 1).collect()
        if len(got) > MOST_ENTRIES:
            raise ValueError(f"a dictionary of more than {MOST_ENTRIES} entries")
        return [tuple(r) for r in got]

    return SEED.extended(rows(tags, TAG_COLUMNS), rows(private, PRIVATE_COLUMNS))
